"""Minimal functional dependencies, by three searches that must agree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.masks import bits, invert_agree_sets, next_level
from ..plans.kernels import Counter, agree_sets
from ..plans.sharded import PLAIN, comparable
from ..sources.tables import attributes

SCHEMA = "lhs string, rhs string, lhs_size int"
#: Rows that each column gives to the sample of a hybrid search.
SAMPLE_ROWS = 2_000
#: How far apart rows of the sample are compared.
DISTANCES = (1, 2, 3, 5, 8)


def names(mask: int, columns: list[str]) -> str:
    return ",".join(columns[i] for i in bits(mask))


def fd_frame(df: DataFrame, found: list[tuple[int, int]], columns: list[str]) -> DataFrame:
    rows = sorted((names(lhs, columns), columns[a], lhs.bit_count()) for lhs, a in found)
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def by_levels(count: Counter, n: int, most: int | None = None) -> list[tuple[int, int]]:
    """Level-wise search. A node X keeps the right-hand sides that may still have
    a minimal left-hand side inside X; a level is counted by one job."""
    full = (1 << n) - 1
    found: list[tuple[int, int]] = []
    allowed = {0: full}
    level = [1 << i for i in range(n)]
    size = 1
    while level and (most is None or size <= most + 1):
        counts = count(level)
        kept = {}
        for x in level:
            rhs = full
            for i in bits(x):
                rhs &= allowed[x & ~(1 << i)]
            for a in bits(x & rhs):
                lhs = x & ~(1 << a)
                if count([lhs])[lhs] == counts[x]:
                    found.append((lhs, a))
                    rhs &= ~(1 << a) & x
            if rhs:
                kept[x] = rhs
        allowed = kept
        level = next_level(kept)
        size += 1
    return found


def by_validation(count: Counter, n: int, seed: set[int], most: int | None = None) -> list[tuple[int, int]]:
    """Candidates from sampled agree sets, validated by counts. Candidates that
    fail grow by every other column until they hold; the sample can only spare
    work, never decide."""
    out: list[tuple[int, int]] = []
    waiting = {}
    for lhs, a in invert_agree_sets(seed, n):
        waiting.setdefault(lhs.bit_count(), set()).add((lhs, a))
    for size in range(n):
        if most is not None and size > most:
            break
        now = [(x, a) for x, a in waiting.pop(size, ()) if not any(b == a and y & x == y for y, b in out)]
        counts = count([m for x, a in now for m in (x, x | 1 << a)])
        for x, a in now:
            if counts[x] == counts[x | 1 << a]:
                out.append((x, a))
            else:
                waiting.setdefault(size + 1, set()).update((x | 1 << b, a) for b in range(n) if b != a and not x >> b & 1)
    return out


def sampled_rows(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """For each column up to SAMPLE_ROWS rows, of the values of least hash first: whole
    groups of rare values, and some rows of frequent ones. Which rows these are
    depends on contents alone. Thinning before the sort leaves each task little to
    send, by value, or by content for values that make up much of the table."""
    content = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    thin = max(1, rows // (1_000 * SAMPLE_ROWS))
    out = None
    for c in columns:
        value = F.xxhash64(F.col(f"`{c}`"))
        by_value, by_content = F.pmod(value, F.lit(thin)) == 0, F.pmod(content, F.lit(thin)) == 0
        part = df.filter(by_value | by_content).orderBy(~by_value, value, content).limit(SAMPLE_ROWS)
        out = part if out is None else out.unionByName(part)
    return out


def sampled_agree_sets(df: DataFrame, columns: list[str], rows: int, null_equals_null: bool = True) -> set[int]:
    """Agree sets of rows that stand near each other among the rows of one value in
    the sample. At most SAMPLE_ROWS rows a column reach the driver; they only seed a
    search. Tables with nested columns, whose values have no plain codes, get no seeds."""
    if not rows or not all(isinstance(f.dataType, PLAIN) for f in df.schema):
        return set()
    sample = sampled_rows(comparable(df), columns, rows).toArrow()
    codes = np.stack([sample[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in columns], 1)
    n, out = len(columns), set()
    for i in range(n):
        for turn in (1, -1):  # the first of the keys counts last in lexsort
            order = np.lexsort([codes[:, (i + turn * k) % n] for k in range(n - 1, -1, -1)])
            for d in DISTANCES:
                a, b = codes[order[d:]], codes[order[:-d]]
                same = (a == b) & (null_equals_null | (a >= 0))
                same = same[same[:, i] & ~same.all(1)]
                packed = np.unique(np.packbits(same, axis=1, bitorder="little"), axis=0)
                out |= {int.from_bytes(m.tobytes(), "little") for m in packed}
    return out


def discover_fds(
    df: DataFrame, columns: list[str] | None = None, id_col: str | None = None, method: str = "levels",
    most: int | None = None, null_equals_null: bool = True, pair_plan: str = "counts",
) -> DataFrame:
    """All minimal, non-trivial dependencies lhs -> rhs with at most ``most`` columns
    on the left. ``method``: levels (counts, set by set), difference (agree sets
    of all pairs, inverted) or hybrid (sampled agree sets, validated by counts).
    """
    columns = attributes(df, columns, id_col)
    df = df.select(*columns).persist()
    try:
        if method == "levels":
            found = by_levels(Counter(df, columns, null_equals_null), len(columns), most)
        elif method == "difference":
            found = invert_agree_sets(agree_sets(df, columns, pair_plan, null_equals_null), len(columns), most)
        elif method == "hybrid":
            count = Counter(df, columns, null_equals_null)
            found = by_validation(count, len(columns), sampled_agree_sets(df, columns, count.rows, null_equals_null), most)
        else:
            raise ValueError(f"unknown method: {method}")
    finally:
        df.unpersist()
    return fd_frame(df, found, columns)


def check_fds(df: DataFrame, candidates: list[tuple[list[str], str]], null_equals_null: bool = True) -> DataFrame:
    """lhs, rhs, lhs_count, both_count, holds for each candidate, from one batch of counts."""
    columns = sorted({c for lhs, a in candidates for c in (*lhs, a)})
    at = {c: 1 << i for i, c in enumerate(columns)}
    pairs = [(sum(at[c] for c in lhs), at[a]) for lhs, a in candidates]
    count = Counter(df, columns, null_equals_null)
    counts = count([m for x, a in pairs for m in (x, x | a)])
    rows = [(",".join(lhs), a, counts[x], counts[x | m], counts[x] == counts[x | m]) for (lhs, a), (x, m) in zip(candidates, pairs)]
    return df.sparkSession.createDataFrame(rows, "lhs string, rhs string, lhs_count bigint, both_count bigint, holds boolean")


def fd_violations(df: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    """The groups of ``lhs`` with more than one value of ``rhs``: their least and largest one, and their rows."""
    value = F.col(f"`{rhs}`")
    groups = df.groupBy(*lhs).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("rows"), F.count(value).alias("present"))
    broken = (F.col("low") != F.col("high")) | (F.col("present").between(1, F.col("rows") - 1))
    return groups.filter(broken).drop("present")
