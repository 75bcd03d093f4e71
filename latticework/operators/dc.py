"""Minimal denial constraints over pairs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.masks import bits, hitting_sets, maximal
from ..functions.predicates import Constraint, Predicate, minimize, predicate_space, text
from ..plans.counts import outcomes
from ..plans.kernels import countable, evidence, mask_words, ordered_of, word_value
from ..plans.pairs import distinct_rows, neighbour_pairs, partner_pairs, sides, triangle_pairs
from ..sources.tables import attributes
from .stats import likeness

SCHEMA = "dc string, n_predicates int"


def space_of(df: DataFrame, columns: list[str], cross_column: bool = False) -> list[Predicate]:
    return predicate_space(df, columns, cross_column, likeness)


def covers(found: set[int], space: list[Predicate], most: int | None = None) -> list[Constraint]:
    """The minimal constraints that every evidence set obeys: a constraint needs a
    predicate outside each evidence, and one predicate at most on two operands."""
    operands = [(p.left, p.l, p.right, p.r) for p in space]
    full = (1 << len(space)) - 1
    hits = hitting_sets([full & ~e for e in maximal(found)], most, lambda k: operands[k])
    return minimize(frozenset(space[k] for k in bits(h)) for h in hits)


def _frame(df: DataFrame, found: list[Constraint]) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted((text(d), len(d)) for d in found), SCHEMA)


def violating_pairs(df: DataFrame, columns: list[str], dc: Constraint, rows: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of different rows on which all predicates hold, over distinct
    rows (ida, ta, a0 .., idb, tb, b0 ..). Equalities between the rows become
    join keys; without any the pairs come from the triangle plan."""
    n = len(columns)
    at = {c: i for i, c in enumerate(columns)}
    rows = distinct_rows(df, columns) if rows is None else rows
    of = lambda c, r: F.col(f"{'ab'[r]}{at[c]}")
    tests = [p.test(of) for p in dc]
    left, right = sides(rows, n)
    if any(p.op == "=" and p.l != p.r for p in dc):
        meet: Column = F.col("ida") != F.col("idb")
        for t in tests:
            meet = meet & t
        return left.join(right, meet)
    pairs = triangle_pairs(rows, n)
    back = pairs.select(*[F.col({"a": "b", "b": "a"}[c[0]] + c[1:] if c[0] in "ab" else {"ida": "idb", "idb": "ida", "ta": "tb", "tb": "ta"}[c]).alias(c) for c in pairs.columns])
    out = pairs.unionByName(back)
    for t in tests:
        out = out.filter(t)
    return out


def dc_violations(df: DataFrame, dc: Constraint | list[Predicate], columns: list[str] | None = None) -> DataFrame:
    """violations: the number of ordered pairs of different rows on which all predicates of ``dc``
    hold. Where no equality makes a join key, pairs are counted by their outcomes, if these can be told."""
    dc = frozenset(dc)
    used = sorted({c for p in dc for c in (p.left, p.right)}) if columns is None else columns
    if all(p.op != "=" for p in dc) and countable(used, dc):
        found = outcomes(df, used, ordered_of(used, dc)).items()
        n = sum(times for outcome, times in found if all(p.accepts(outcome[used.index(p.left)]) for p in dc))
        return df.sparkSession.createDataFrame([(n,)], "violations long")
    rows = distinct_rows(df, used)
    met = violating_pairs(df, used, dc, rows).agg(F.coalesce(F.sum(F.col("ta") * F.col("tb")), F.lit(0)).cast("bigint").alias("n"))
    at = {c: i for i, c in enumerate(used)}
    own = rows.filter("_times > 1")
    for p in dc:
        own = own.filter(p.test(lambda c, r: F.col(f"_{at[c]}")))
    own = own.agg(F.coalesce(F.sum(F.col("_times") * (F.col("_times") - 1)), F.lit(0)).cast("bigint").alias("n"))
    return met.unionByName(own).agg(F.sum("n").cast("bigint").alias("violations"))


def evidence_sets(df: DataFrame, columns: list[str] | None = None, id_col: str | None = None, cross_column: bool = False, plan: str = "counts") -> DataFrame:
    """predicates (text, in the order of the space), pairs: the distinct evidence of ordered pairs."""
    columns = attributes(df, columns, id_col)
    space = space_of(df, columns, cross_column)
    found = evidence(df, columns, space, plan)
    words = [F.when(F.col(f"m{k // 62}").bitwiseAND(F.lit(1 << k % 62)) != 0, F.lit(str(p))) for k, p in enumerate(space)]
    return found.select(F.concat_ws(" AND ", *words).alias("predicates"), "pairs")


def discover_dcs(
    df: DataFrame, columns: list[str] | None = None, id_col: str | None = None, method: str = "evidence",
    most: int | None = None, cross_column: bool = False, pair_plan: str = "counts", partners: int = 20,
) -> DataFrame:
    """All minimal constraints of at most ``most`` predicates.

    evidence: from the evidence of all pairs. hybrid: from sampled pairs first;
    the pairs that violate what the sample suggests are joined and add their
    evidence, until no suggestion is violated. Both are exact.
    """
    columns = attributes(df, columns, id_col)
    space = space_of(df, columns, cross_column)
    df = df.select(*columns).persist()
    try:
        if method == "evidence":
            rows = evidence(df, columns, space, pair_plan).collect()
            return _frame(df, covers({word_value(r, len(space)) for r in rows}, space, most))
        if method != "hybrid":
            raise ValueError(f"unknown method: {method}")
        base = distinct_rows(df, columns)
        n = len(columns)
        sample = partner_pairs(base, n, partners).unionByName(neighbour_pairs(base, n))
        known = {word_value(r, len(space)) for r in evidence(df, columns, space, pairs=sample).collect()}
        # equal rows satisfy just the predicates that accept equality inside a row
        at = {c: i for i, c in enumerate(columns)}
        own = base.filter("_times > 1").select(*mask_words([p.test(lambda c, r: F.col(f"_{at[c]}")) for p in space]))
        known |= {word_value(r, len(space)) for r in own.distinct().collect()}
        checked: set[Constraint] = set()
        while True:
            suggested = covers(known, space, most)
            new = set()
            for dc in suggested:
                if dc in checked:
                    continue
                pairs = violating_pairs(df, columns, dc)
                more = {word_value(r, len(space)) for r in evidence(df, columns, space, pairs=pairs).collect()}
                if more - known:
                    new |= more
                else:
                    checked.add(dc)
            if not new - known:
                return _frame(df, suggested)
            known |= new
    finally:
        df.unpersist()
