"""The four kernels that all discovery reduces to, as DataFrame plans.

K1 distinct counts of many column sets; K2 distinct agree sets of row pairs;
K3 order swaps inside the groups of a context; K4 distinct predicate evidence
of row pairs. Each returns a small result; the searches run on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.masks import bits
from ..functions.predicates import Predicate
from .counts import COUNTED, ORDERED, exactly, outcomes, pairs_agreeing, pairs_of_classes
from .encode import keyed, ordered
from .pairs import PLANS, agreement_classes, distinct_rows
from .sharded import column_groups, dealing, plain, sharded_agree_sets, sharded_counts

#: Column sets counted by one job: the rows that its Expand makes are rows * sets.
SETS_AT_ONCE = 48
#: Column sets, and rows times sets, above which rows are dealt out by a column instead of expanded.
MANY_SETS, MANY_ROWS = 16, 1 << 20
#: Candidates checked for swaps by one job.
CHECKS_AT_ONCE = 24
#: Classes of rows above which a pair plan does not meet their pairs (34 million) if these can be counted.
MEET_CLASSES = {"nested": 1 << 13, "triangle": 1 << 13, "sharing": 1 << 13}
#: A mask column holds this many bits; wider tables use more columns.
WORD = 62


# K1


def distinct_counts(keys: DataFrame, masks: Iterable[int], rows: int, at_once: int = SETS_AT_ONCE) -> dict[int, int]:
    """Distinct value combinations of each column set over ``keys`` (nulls equal
    nulls). One job for ``at_once`` sets: rows are expanded once for each set,
    pre-aggregated where they are read, and counted by set."""
    masks = list(dict.fromkeys(masks))
    out = {m: min(1, rows) for m in masks if m == 0}
    if not rows:
        return dict.fromkeys(masks, 0)
    todo = [m for m in masks if m]
    for at in range(0, len(todo), at_once):
        part = todo[at : at + at_once]
        used = list(bits(reduce(int.__or__, part)))
        names = [f"k{i}" for i in used]
        source = keys.select(*[F.col(f"`{keys.columns[i]}`").alias(f"k{i}") for i in used])
        if len(part) == 1:
            out[part[0]] = source.distinct().count()
            continue
        sets = [[f"k{i}" for i in bits(m)] for m in part]
        if len(used) <= 63:
            groups = source.groupingSets(sets, *names).agg(F.grouping_id().alias("gid"))
            # a bit of the id is set for each column that a group lacks, the first column highest
            top = len(used) - 1
            by_id = {sum(1 << (top - k) for k, i in enumerate(used) if not m >> i & 1): m for m in part}
        else:
            keyed_sets = [F.struct(F.lit(n).alias("gid"), F.to_json(F.struct(*s)).alias("key")) for n, s in enumerate(sets)]
            groups = source.select(F.explode(F.array(*keyed_sets)).alias("x")).select("x.*").distinct()
            by_id = dict(enumerate(part))
        found = {r["gid"]: r["n"] for r in groups.groupBy("gid").agg(F.count("*").alias("n")).collect()}
        out |= {m: found.get(g, 0) for g, m in by_id.items()}
    return out


class Counter:
    """Counts of column sets, each counted once; supersets of a key need no count.

    Many sets at once are counted by shards (see :mod:`.sharded`): one job, whose
    shuffle carries rows once for each column that they are dealt by. Sets without
    such a column have few values; they are counted by groups, as are columns whose
    equality is Spark's alone."""

    def __init__(self, df: DataFrame, columns: list[str], null_equals_null: bool = True, at_once: int = SETS_AT_ONCE):
        self.keys = keyed(df, columns, null_equals_null)
        self.at_once = at_once
        self.rows = df.count()
        self.known: dict[int, int] = {0: min(1, self.rows)}
        self.unique: list[int] = []
        self.jobs = 0
        self.groups: dict[int, tuple[int, int]] | None = None
        self.plain = plain(self.keys)

    def by_shards(self, sets: int) -> bool:
        """Whether so many column sets are counted by shards."""
        return bool(self.rows and self.plain and sets > 1 and (sets > MANY_SETS or sets * self.rows > MANY_ROWS))

    def _dealing(self) -> tuple[list[int], list[int]]:
        """The columns that deal rows out, and all columns, those with the most values first."""
        if self.groups is None:
            self.groups = column_groups(self.keys, self.at_once)
            self.jobs += 1
        return dealing(self.groups, self.rows), sorted(self.groups, key=lambda i: (-self.groups[i][0], i))

    def repeats(self) -> tuple[set[int], int]:
        """Agree sets of pairs of rows, and a mask of columns: a set that has one of
        these columns is unique if and only if no agree set contains it. The mask has
        no column of few values, see :func:`.sharded.dealing`."""
        bases, order = self._dealing()
        several = [b for b in bases if self.groups[b][0] < self.rows]  # no two rows agree on a key
        self.jobs += bool(several)
        return sharded_agree_sets(self.keys, several, order, self.rows) if several else set(), sum(1 << b for b in bases)

    def may_be_unique(self, mask: int) -> bool:
        """Whether the columns, once grouped, have as many combinations of values as there are rows."""
        return self.groups is None or prod(self.groups[i][0] for i in bits(mask)) >= self.rows

    def _counts(self, masks: list[int]) -> dict[int, int]:
        found: dict[int, int] = {}
        if self.by_shards(len(masks)):
            bases, order = self._dealing()
            found = {m: self.groups[m.bit_length() - 1][0] for m in masks if m.bit_count() == 1}
            base_of = {m: b for m in masks if m.bit_count() > 1 and (b := next((c for c in bases if m >> c & 1), None)) is not None}
            if base_of:
                found |= sharded_counts(self.keys, list(base_of), base_of, order, self.rows)
                self.jobs += 1
            masks = [m for m in masks if m not in found]
        self.jobs += -(-len(masks) // self.at_once)
        return found | distinct_counts(self.keys, masks, self.rows, self.at_once)

    def __call__(self, masks: Iterable[int]) -> dict[int, int]:
        masks = list(masks)
        new = []
        for m in dict.fromkeys(masks):
            if m not in self.known:
                if any(u & m == u for u in self.unique):
                    self.known[m] = self.rows
                else:
                    new.append(m)
        if new:
            found = self._counts(new)
            self.known |= found
            self.unique += [m for m in sorted(new, key=int.bit_count) if found[m] == self.rows and not any(u & m == u for u in self.unique)]
        return {m: self.known[m] for m in masks}


# K2


def mask_words(tests: list[Column]) -> list[Column]:
    """Tests as bits of one or more bigint columns."""
    out = []
    for at in range(0, len(tests), WORD):
        part = [F.when(t, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, t in enumerate(tests[at : at + WORD])]
        out.append(reduce(lambda a, b: a.bitwiseOR(b), part).alias(f"m{at // WORD}"))
    return out


def word_value(row, n: int) -> int:
    return sum(row[f"m{k}"] << (WORD * k) for k in range(-(-n // WORD)))


def agree_masks(df: DataFrame, columns: list[str], plan: str = "triangle", null_equals_null: bool = True) -> DataFrame:
    """m0, m1, ...: the distinct agree sets of pairs of different rows, made at once.

    counts: from the sizes of the groups of every column set, for up to ``COUNTED``
    columns; wider tables go by the triangle plan. The pair plans meet classes of
    rows instead of rows (see :func:`agreement_classes`); a class of several rows
    adds the set of the values that it has in common. Pairs of more classes than
    ``MEET_CLASSES`` are counted where they can be, as their number grows with the
    square of the classes."""
    n = len(columns)
    words = range(-(-n // WORD))
    if plan == "counts" and n <= COUNTED:
        return _mask_frame(df, _occurring(pairs_agreeing(df, columns, null_equals_null), n), n)
    plan = "triangle" if plan == "counts" else plan
    rows = agreement_classes(df, columns, null_equals_null).persist()
    try:
        if n <= COUNTED and plan in MEET_CLASSES and rows.count() > MEET_CLASSES[plan]:
            return _mask_frame(df, _occurring(pairs_of_classes(rows, n), n), n)
        same = lambda i: F.coalesce(F.col(f"a{i}") == F.col(f"b{i}"), F.lit(False))
        met = PLANS[plan](rows, n).select(*mask_words([same(i) for i in range(n)]))
        met = met.groupBy(*[f"m{k}" for k in words]).agg(F.count("*").alias("pairs")).collect()
        found = {word_value(r, n) for r in met}
        twice = rows.filter("_times > 1").select(*mask_words([F.col(f"_{i}").isNotNull() for i in range(n)])).distinct().collect()
        found |= {word_value(r, n) for r in twice}
        if plan == "sharing":
            # the empty set, if fewer pairs share a value than there are pairs
            total = rows.count()
            if sum(r["pairs"] for r in met) < total * (total - 1) // 2:
                found.add(0)
    finally:
        rows.unpersist()
    return _mask_frame(df, sorted(found), n)


def _occurring(least: dict[int, int], n: int) -> list[int]:
    return sorted(m for m, p in exactly(least, range(n)).items() if p)


def _mask_frame(df: DataFrame, masks: list[int], n: int) -> DataFrame:
    words = range(-(-n // WORD))
    rows = [tuple(m >> WORD * k & (1 << WORD) - 1 for k in words) for m in masks]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"m{k} long" for k in words))


def agree_sets(df: DataFrame, columns: list[str], plan: str = "triangle", null_equals_null: bool = True) -> set[int]:
    return {word_value(r, len(columns)) for r in agree_masks(df, columns, plan, null_equals_null).collect()}


# K3


def swaps(df: DataFrame, candidates: list[tuple[list[str], str, str, bool]], at_once: int = CHECKS_AT_ONCE) -> list[bool]:
    """For each (context, a, b, descending): whether two rows with one context
    value have a smaller and b larger (with descending: also smaller).

    Groups of (context, a) are reduced to the smallest and largest b; inside a
    context, ordered by a, neighbours show a swap if there is any. Without a
    context the groups are range-partitioned by a: neighbours are compared
    inside each part, and parts by their extremes."""
    out: list[bool] = []
    for at in range(0, len(candidates), at_once):
        checks = [_swap_check(df, *c).select(F.lit(k).alias("k"), "swap") for k, c in enumerate(candidates[at : at + at_once])]
        rows = {r["k"]: r["swap"] for r in reduce(DataFrame.unionByName, checks).collect()}
        out += [bool(rows[k]) for k in range(len(checks))]
    return out


def _swap_check(df: DataFrame, context: list[str], a: str, b: str, descending: bool) -> DataFrame:
    groups = df.groupBy(*context, a).agg(F.min(ordered(b)).alias("lo"), F.max(ordered(b)).alias("hi"))
    groups = groups.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(context)], ordered(a).alias("a"), "lo", "hi")

    def swapped(w) -> Column:
        return F.lag("lo").over(w) < F.col("hi") if descending else F.lag("hi").over(w) > F.col("lo")

    if context:
        w = Window.partitionBy(*[f"x{i}" for i in range(len(context))]).orderBy("a")
        return groups.select(swapped(w).alias("swap")).agg(F.coalesce(F.max("swap"), F.lit(False)).alias("swap"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = groups.repartitionByRange(n, "a").withColumn("part", F.spark_partition_id())
    inner = parts.select("part", "a", "lo", "hi", swapped(Window.partitionBy("part").orderBy("a")).alias("swap"))
    ends = inner.groupBy("part").agg(F.max("swap").alias("swap"), F.min("a").alias("a"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # a row for each part, so one window over them is bounded by the number of partitions
    outer = ends.select((F.coalesce("swap", F.lit(False)) | F.coalesce(swapped(Window.orderBy("a")), F.lit(False))).alias("swap"))
    return outer.agg(F.coalesce(F.max("swap"), F.lit(False)).alias("swap"))


# K4


def evidence(df: DataFrame, columns: list[str], space: list[Predicate], plan: str = "triangle", pairs: DataFrame | None = None) -> DataFrame:
    """m0, m1, ..., pairs: the distinct sets of predicates that ordered pairs of
    different rows satisfy, with the number of such pairs.

    counts: from the sizes of groups and from pairs of columns that rise together,
    if the space compares each column with itself only and up to ``ORDERED`` of
    ``COUNTED`` columns by order; other spaces go by the triangle plan."""
    n = len(columns)
    words = [f"m{k}" for k in range(-(-len(space) // WORD))]
    if plan == "counts" and pairs is None and countable(columns, space):
        met: dict[int, int] = {}
        for found, times in outcomes(df, columns, ordered_of(columns, space)).items():
            outcome = dict(zip(columns, found))
            mask = sum(1 << k for k, p in enumerate(space) if p.accepts(outcome[p.left]))
            met[mask] = met.get(mask, 0) + times
        rows = [(*(m >> WORD * k & (1 << WORD) - 1 for k in range(len(words))), times) for m, times in sorted(met.items())]
        return df.sparkSession.createDataFrame(rows, ", ".join(f"{c} long" for c in (*words, "pairs")))
    plan = "triangle" if plan == "counts" else plan
    rows = distinct_rows(df, columns)
    met = PLANS[plan](rows, n) if pairs is None else pairs
    at = {c: i for i, c in enumerate(columns)}
    side = lambda p, q: (lambda column, row: F.col(f"{(p, q)[row]}{at[column]}"))
    there = met.select((F.col("ta") * F.col("tb")).alias("pairs"), *mask_words([p.test(side("a", "b")) for p in space]))
    back = met.select((F.col("ta") * F.col("tb")).alias("pairs"), *mask_words([p.test(side("b", "a")) for p in space]))
    own = lambda column, row: F.col(f"_{at[column]}")
    twice = rows.filter("_times > 1").select((F.col("_times") * (F.col("_times") - 1)).alias("pairs"), *mask_words([p.test(own) for p in space]))
    every = there.unionByName(back)
    if pairs is None:
        every = every.unionByName(twice)
    return every.groupBy(*words).agg(F.sum("pairs").cast("bigint").alias("pairs"))


def ordered_of(columns: list[str], space: Iterable[Predicate]) -> set[int]:
    """The columns that a space compares by order."""
    return {columns.index(p.left) for p in space if p.op not in ("=", "<>")}


def countable(columns: list[str], space: Iterable[Predicate]) -> bool:
    """Whether the counts plan can tell the pairs of every outcome of a space."""
    space = list(space)
    return len(columns) <= COUNTED and len(ordered_of(columns, space)) <= ORDERED and all(p.left == p.right and (p.l, p.r) == (0, 1) for p in space)
