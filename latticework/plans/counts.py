"""What pairs of rows have in common, by counts of groups instead of pairs.

The pairs that agree on a column set at least are known from the sizes of its
groups; inclusion and exclusion over supersets gives those that agree on it
exactly. How pairs that differ are ordered follows, for up to three ordered
columns, from the pairs in which two of them rise together. Work grows with
rows, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.masks import bits, next_level
from ..sources.shipping import ship
from .encode import distinct_ranks, keyed

#: Columns of a table whose sets are all counted; wider tables go by pairs.
COUNTED = 10
#: Ordered columns whose joint order pairs of columns decide.
ORDERED = 3
#: Column sets counted by one job.
SETS_AT_ONCE = 48
#: Rows that one task orders at once.
BLOCK = 250_000


def pairs_within(keys: DataFrame, masks: list[int], times: str | None = None) -> dict[int, int]:
    """The unordered pairs of rows that agree on each column set at least. With
    ``times``, the column that says how many rows a row stands for, a null agrees
    with none."""
    out = {}
    for at in range(0, len(masks), SETS_AT_ONCE):
        part = masks[at : at + SETS_AT_ONCE]
        used = sorted({i for m in part for i in bits(m)})
        names = [f"k{i}" for i in used]
        source = keys.select(*[F.col(f"`{keys.columns[i]}`").alias(f"k{i}") for i in used], (F.col(times) if times else F.lit(1)).alias("times"))
        sets = [[f"k{i}" for i in bits(m)] for m in part]
        groups = source.groupingSets(sets, *names).agg(F.grouping_id().alias("gid"), F.sum("times").cast("decimal(19,0)").alias("n"), *[F.grouping(c).alias(f"no_{c}") for c in names]).filter("n > 1")
        for c in names if times else ():
            groups = groups.filter(f"no_{c} = 1 or {c} is not null")
        found = {r["gid"]: int(r["p"]) for r in groups.groupBy("gid").agg(F.sum(F.expr("n * (n - 1)")).alias("p")).collect()}
        # a bit of the id is set for each column that a group lacks, the first column highest
        top = len(used) - 1
        out |= {m: found.get(sum(1 << (top - k) for k, i in enumerate(used) if not m >> i & 1), 0) // 2 for m in part}
    return out


def pairs_agreeing(df: DataFrame, columns: list[str], null_equals_null: bool = True) -> dict[int, int]:
    """For each column set on which two rows agree, the unordered pairs that agree on
    it at least. Sets that hold one without pairs are not counted."""
    return _by_levels(keyed(df, columns, null_equals_null), len(columns), df.count())


def pairs_of_classes(classes: DataFrame, n: int) -> dict[int, int]:
    """The same from the :func:`.pairs.agreement_classes` of a table of n columns."""
    rows = classes.agg(F.sum("_times")).collect()[0][0] or 0
    return _by_levels(classes.select(*[f"_{i}" for i in range(n)], "_times"), n, rows, "_times")


def _by_levels(keys: DataFrame, n: int, rows: int, times: str | None = None) -> dict[int, int]:
    out = {0: rows * (rows - 1) // 2}
    level = [1 << i for i in range(n)] if out[0] else []
    while level:
        found = {m: p for m, p in pairs_within(keys, level, times).items() if p}
        out |= found
        level = next_level(found)
    return out if out[0] else {}


def exactly(least: dict[int, int], over: Iterable[int]) -> dict[int, int]:
    """From the pairs that agree on sets at least those that agree on no more of
    the columns ``over``."""
    out = dict(least)
    for i in over:
        for m in [m for m in out if not m >> i & 1]:
            out[m] -= out.get(m | 1 << i, 0)
    return out


def concordant(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
    """The pairs inside groups in which a and b differ and rise together. Rows stand
    by group and b (of equal b the larger a first) and are parted by the bits of a,
    the highest first: two rows come apart at the first bit in which they differ."""
    if not len(a):
        return 0
    a = np.unique(a, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((-a, b, group))
    a, group = a[order], group[order]
    part = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    total = 0
    for bit in range(int(a.max()).bit_length() - 1, -1, -1):
        size = np.bincount(part)
        several = (size > 1)[part]
        a, part = a[several], part[several]
        if not len(a):
            break
        part = np.cumsum(np.r_[False, part[1:] != part[:-1]])
        begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        one = (a >> bit & 1).astype(bool)
        before = np.r_[0, np.cumsum(~one)]  # zeros before a row
        total += int((before[:-1] - before[begin][part])[one].sum())
        part = 2 * part + one
        order = np.argsort(part, kind="stable")
        a, part = a[order], part[order]
    return total


def _groups(codes: list[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for c in codes:
        c = np.unique(c, return_inverse=True)[1]
        out = np.unique(out * (int(c.max()) + 1) + c, return_inverse=True)[1]
    return out


def _rising(sets: dict[str, list[int]]):
    """Concordant pairs of one block, for each column set that pairs are to agree on."""

    def run(table: pa.Table) -> pa.Table:
        which = table.column("which")[0].as_py()
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        masks = sets[which]
        found = [concordant(_groups([table.column(f"c{i}").to_numpy() for i in bits(m)], len(a)), a, b) for m in masks]
        return pa.table([pa.array([which] * len(masks), pa.string()), pa.array(masks, pa.int64()), pa.array(found, pa.int64())], ["which", "mask", "pairs"])

    return run


def _bounds(codes: DataFrame, column: str, rows: int) -> list[int]:
    """First values of blocks of about ``BLOCK`` rows; a value that fills a block of its own is alone in it."""
    n = -(-rows // BLOCK)
    if n < 2:
        return []
    cuts = [int(x) for x in codes.approxQuantile(column, [k / n for k in range(1, n)], 0.1 / n)]
    return sorted({*cuts, *(x + 1 for x in cuts if cuts.count(x) > 1)})


def _block(column: str, bounds: list[int]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in bounds]), lambda x: x <= F.col(column))).cast("bigint") if bounds else F.lit(0).cast("bigint")


def _several(block: Column, bounds: list[int]) -> Column:
    """Whether a block may hold several values."""
    single = [k + 1 for k, x in enumerate(bounds[:-1]) if bounds[k + 1] == x + 1]
    return ~block.isin(single) if single else F.lit(True)


def pairs_rising(codes: DataFrame, rows: int, wanted: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], dict[int, int]]:
    """For columns (i, j) of ``codes`` (c0, c1, ..: numbers in the order of the values)
    and each column set: the unordered pairs of rows that agree on the set and in
    which i and j differ and rise together.

    Rows are dealt to blocks of values of i and of j. Pairs in one block of i meet
    there, pairs in one block of j, but not of i, there; for others their blocks
    tell the order, so these are counted by cells of two blocks."""
    met, sets, out = None, {}, {k: dict.fromkeys(masks, 0) for k, masks in wanted.items()}
    own = codes.columns
    bounds = {i: _bounds(codes, f"c{i}", rows) for i in sorted({i for k in wanted for i in k})}
    for i, x in bounds.items():
        codes = codes.withColumn(f"b{i}", _block(f"c{i}", x))
    cells: list[DataFrame] = []
    for (i, j), masks in wanted.items():
        which = f"{i},{j}"
        sets[which] = masks
        parts = [codes.filter(_several(F.col(f"b{i}"), bounds[i])).select(F.lit(which).alias("which"), F.lit(0).alias("side"), F.col(f"b{i}").alias("block"), *own, F.col(f"c{i}").alias("a"), F.col(f"c{j}").alias("b"))]
        if bounds[i]:
            parts.append(codes.filter(_several(F.col(f"b{j}"), bounds[j])).select(F.lit(which).alias("which"), F.lit(1).alias("side"), F.col(f"b{j}").alias("block"), *own, F.col(f"b{i}").alias("a"), F.col(f"c{j}").alias("b")))
        for p in parts:
            met = p if met is None else met.unionByName(p)
        cells += [_cells(codes, which, m) for m in masks if bounds[i] and bounds[j]]
    if met is None:
        return out
    ship(codes.sparkSession)
    found = met.groupBy("which", "side", "block").applyInArrow(_rising(sets), "which string, mask long, pairs long").collect()
    for r in found + [r for c in cells for r in c.collect()]:
        i, j = map(int, r["which"].split(","))
        out[i, j][r["mask"]] += int(r["pairs"] or 0)
    return out


def _cells(codes: DataFrame, which: str, mask: int) -> DataFrame:
    """The concordant pairs that differ in the blocks of both columns: a group has a
    cell for each two blocks at most."""
    i, j = which.split(",")
    by = [f"c{k}" for k in bits(mask)]
    cell = codes.groupBy(*by, F.col(f"b{i}").alias("x"), F.col(f"b{j}").alias("y")).agg(F.count("*").alias("n"))
    group = cell.groupBy(*by).agg(F.collect_list(F.struct("x", "y", "n")).alias("cells")).filter("size(cells) > 1")
    above = "aggregate(filter(cells, q -> q.x > p.x AND q.y > p.y), 0L, (s, q) -> s + q.n)"
    rising = F.expr(f"aggregate(transform(cells, p -> p.n * {above}), 0L, (s, v) -> s + v)")
    return group.agg(F.sum(rising.cast("decimal(19,0)")).alias("pairs")).select(F.lit(which).alias("which"), F.lit(mask).cast("bigint").alias("mask"), "pairs")


def outcomes(df: DataFrame, columns: list[str], ordered: set[int]) -> dict[tuple[int, ...], int]:
    """The ordered pairs of different rows by outcome: for each column 0 if the two
    agree, else 1, or for ``ordered`` columns -1 (the first is less) or 1. Nulls
    are equal and least. At most ``ORDERED`` ordered columns."""
    n = len(columns)
    if len(ordered) > ORDERED:
        raise ValueError(f"the order of more than {ORDERED} columns does not follow from pairs of them")
    least = pairs_agreeing(df, columns)
    exact = exactly(least, range(n))
    two = [(i, j) for i in sorted(ordered) for j in sorted(ordered) if i < j]
    rising: dict[tuple[int, int], dict[int, int]] = {}
    if two and least:
        used = sorted({*ordered, *(i for m in least for i in bits(m))})
        source = codes = df.select(*[F.col(f"`{columns[i]}`").alias(f"c{i}") for i in used])
        for i in used:
            ranks = distinct_ranks(source, f"c{i}").withColumnsRenamed({"value": "_value", "rank": "_rank"})
            codes = codes.join(ranks, F.col(f"c{i}").eqNullSafe(F.col("_value"))).drop("_value", f"c{i}").withColumnRenamed("_rank", f"c{i}")
        codes = codes.persist()
        try:
            wanted = {(i, j): [m for m in least if not m >> i & 1 and not m >> j & 1] for i, j in two}
            risen = pairs_rising(codes, codes.count(), wanted)
            rising = {k: exactly(x, [c for c in range(n) if c not in k]) for k, x in risen.items()}
        finally:
            codes.unpersist()
    out: dict[tuple[int, ...], int] = {}

    def add(mask: int, signs: dict[int, int], pairs: int) -> None:
        for turn in (1, -1):
            key = tuple(0 if mask >> c & 1 else turn * signs[c] if c in signs else 1 for c in range(n))
            if pairs:
                out[key] = out.get(key, 0) + pairs

    for mask, pairs in exact.items():
        free = [c for c in sorted(ordered) if not mask >> c & 1]
        if len(free) < 2:
            add(mask, dict.fromkeys(free, -1), pairs)
        elif len(free) == 2:
            up = rising[free[0], free[1]][mask]
            add(mask, dict.fromkeys(free, -1), up)
            add(mask, {free[0]: -1, free[1]: 1}, pairs - up)
        else:
            i, j, k = free
            up = {x: rising[x][mask] for x in ((i, j), (i, k), (j, k))}
            # every pair rises together in all three or in just one two of them
            all_three = (sum(up.values()) - pairs) // 2
            add(mask, {i: -1, j: -1, k: -1}, all_three)
            add(mask, {i: -1, j: -1, k: 1}, up[i, j] - all_three)
            add(mask, {i: -1, j: 1, k: -1}, up[i, k] - all_three)
            add(mask, {i: 1, j: -1, k: -1}, up[j, k] - all_three)
    return out
