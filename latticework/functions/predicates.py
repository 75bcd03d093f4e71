"""Predicates over two rows, the spaces of them, and denial constraints."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

#: An operator as the set of outcomes of a comparison that it accepts.
LESS, EQUAL, MORE = 1, 2, 4
OUTCOMES = {"=": EQUAL, "<>": LESS | MORE, "<": LESS, "<=": LESS | EQUAL, ">": MORE, ">=": MORE | EQUAL}
OF_OUTCOMES = {v: k for k, v in OUTCOMES.items()}


def inverse(op: str) -> str:
    """a op b holds if and only if a inverse(op) b does not."""
    return OF_OUTCOMES[7 & ~OUTCOMES[op]]


def symmetric(op: str) -> str:
    """a op b holds if and only if b symmetric(op) a does."""
    o = OUTCOMES[op]
    return OF_OUTCOMES[(o & EQUAL) | (MORE if o & LESS else 0) | (LESS if o & MORE else 0)]


def implied(op: str) -> list[str]:
    """The operators that hold whenever op does."""
    return [k for k, v in OUTCOMES.items() if OUTCOMES[op] & ~v == 0]


def composed(first: str, second: str) -> str | None:
    """The operator that a has to c if a first b and b second c; None if any outcome is possible."""
    out = 0
    for a, b in product((LESS, EQUAL, MORE), repeat=2):
        if OUTCOMES[first] & a and OUTCOMES[second] & b:
            out |= a if b == EQUAL else b if a == EQUAL or a == b else 7
    return OF_OUTCOMES.get(out)


@dataclass(frozen=True, order=True)
class Predicate:
    """left of row ``l`` compared with right of row ``r``; rows are 0 and 1."""

    left: str
    op: str
    right: str
    l: int = 0  # noqa: E741
    r: int = 1

    def swapped(self) -> Predicate:
        """The same test with the rows exchanged, its operands in the given order."""
        p = Predicate(self.left, self.op, self.right, 1 - self.l, 1 - self.r)
        return Predicate(p.right, symmetric(p.op), p.left, p.r, p.l) if p.l > p.r else p

    def test(self, of: Callable[[str, int], Column]) -> Column:
        """The test as a Column that is never null: a null equals a null and is less
        than any value, so that just one of <, = and > holds."""
        a, b = of(self.left, self.l), of(self.right, self.r)
        less = lambda x, y: F.coalesce(x < y, x.isNull() & y.isNotNull())
        return {
            "=": lambda: a.eqNullSafe(b), "<>": lambda: ~a.eqNullSafe(b), "<": lambda: less(a, b), ">": lambda: less(b, a),
            "<=": lambda: ~less(b, a), ">=": lambda: ~less(a, b),
        }[self.op]()

    def accepts(self, outcome: int) -> bool:
        """Whether it holds if its left side is less (-1), equal (0) or more (1)."""
        return bool(OUTCOMES[self.op] & (LESS, EQUAL, MORE)[outcome + 1])

    def __str__(self) -> str:
        return f"t{self.l + 1}.{self.left} {self.op} t{self.r + 1}.{self.right}"


def is_ordered(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (NumericType, DateType, TimestampType, TimestampNTZType))


#: Columns may be compared for equality if their values overlap so much, and for order if their means are that close.
LEAST_OVERLAP, LEAST_RATIO = 0.15, 0.1


def predicate_space(df: DataFrame, columns: list[str], cross_column: bool = False, overlap: Callable | None = None) -> list[Predicate]:
    """The predicates to search: each column with itself over two rows, and, on
    request, pairs of columns of one type whose values are alike, over two rows
    and inside one. Ordered columns have six operators, others two."""
    out = []
    for c in columns:
        out += [Predicate(c, op, c) for op in (OUTCOMES if is_ordered(df, c) else ("=", "<>"))]
    if cross_column:
        for a in columns:
            for b in columns:
                if a >= b or df.schema[a].dataType != df.schema[b].dataType:
                    continue
                share, ratio = overlap(df, a, b)
                join, compare = share > LEAST_OVERLAP, is_ordered(df, a) and ratio > LEAST_RATIO
                if join or compare:
                    ops = OUTCOMES if compare else ("=", "<>")
                    out += [Predicate(a, op, b, 0, 1) for op in ops] + [Predicate(b, op, a, 0, 1) for op in ops]
                if join:
                    out += [Predicate(a, op, b, 0, 0) for op in ("=", "<>")]
    return out


Constraint = frozenset  # of Predicate: not all of them hold for one pair of rows


def text(dc: Iterable[Predicate]) -> str:
    """A constraint's one spelling: predicates sorted, the lesser of itself and its swap."""
    one = lambda d: " AND ".join(sorted(map(str, d)))
    dc = list(dc)
    return f"NOT({min(one(dc), one(p.swapped() for p in dc))})"


class Relations:
    """What a conjunction says about its operands: for each pair of operands the
    possible outcomes of their comparison, closed under composition."""

    def __init__(self, dc: Iterable[Predicate]):
        dc = list(dc)
        self.nodes = sorted({x for p in dc for x in ((p.left, p.l), (p.right, p.r))})
        self.may = {(a, b): (EQUAL if a == b else 7) for a in self.nodes for b in self.nodes}
        for p in dc:
            a, b = (p.left, p.l), (p.right, p.r)
            self.may[a, b] &= OUTCOMES[p.op]
            self.may[b, a] &= OUTCOMES[symmetric(p.op)]
        changed = True
        while changed:
            changed = False
            for a, b, c in product(self.nodes, repeat=3):
                x, y = self.may[a, b], self.may[b, c]
                both = 0
                for u, v in product((LESS, EQUAL, MORE), repeat=2):
                    if x & u and y & v:
                        both |= u if v == EQUAL else v if u == EQUAL or u == v else 7
                if self.may[a, c] & ~both:
                    self.may[a, c] &= both
                    changed = True

    @property
    def contradictory(self) -> bool:
        return any(v == 0 for v in self.may.values())

    def entails(self, p: Predicate) -> bool:
        key = ((p.left, p.l), (p.right, p.r))
        return key in self.may and self.may[key] & ~OUTCOMES[p.op] == 0


def minimize(constraints: Iterable[Constraint]) -> list[Constraint]:
    """Without the trivial ones, and without those that another implies, as it
    stands or with its rows exchanged; of equal ones the smallest."""
    todo = sorted(((len(d), text(d), d, Relations(d)) for d in set(constraints)), key=lambda x: x[:2])
    todo = [x for x in todo if not x[3].contradictory]
    kept: list[tuple[Constraint, Relations]] = []

    def implies(d: Constraint, rel: Relations) -> bool:
        return all(rel.entails(p) for p in d) or all(rel.entails(p.swapped()) for p in d)

    for _, _, d, rel in todo:
        if any(implies(k, rel) for k, _ in kept):
            continue
        kept = [(k, r) for k, r in kept if not implies(d, r)]
        kept.append((d, rel))
    return [d for d, _ in kept]
