"""Minimal unique column combinations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.masks import invert_for_keys, next_level
from ..plans.kernels import WORD, Counter, agree_sets
from ..sources.tables import attributes
from .fd import names, sampled_agree_sets

SCHEMA = "columns string, size int"


def by_levels(count: Counter, n: int, most: int | None = None) -> list[int]:
    if count.rows <= 1:
        return [0]
    found: list[int] = []
    level, size = [1 << i for i in range(n)], 1
    while level and (most is None or size <= most):
        counts = count(level)
        found += [x for x in level if counts[x] == count.rows]
        level = next_level(x for x in level if counts[x] < count.rows)
        size += 1
    return found


def by_validation(unique: Callable[[list[int]], set[int]], n: int, seed: set[int], most: int | None = None) -> list[int]:
    """``unique``: which of some column sets are unique. Seeds spare work, never decide."""
    out: list[int] = []
    waiting: dict[int, set[int]] = {}
    for x in invert_for_keys(seed, n):
        waiting.setdefault(x.bit_count(), set()).add(x)
    for size in range(n + 1):
        if most is not None and size > most:
            break
        now = [x for x in waiting.pop(size, ()) if not any(y & x == y for y in out)]
        good = unique(now)
        for x in now:
            if x in good:
                out.append(x)
            else:
                waiting.setdefault(size + 1, set()).update(x | 1 << b for b in range(n) if not x >> b & 1)
    return out


def by_shards(count: Counter, n: int, most: int | None = None) -> list[int]:
    """One job tells all sets with a column that deals rows out; the others are counted, unless they have too few values."""
    agree, dealt = count.repeats()

    def unique(sets: list[int]) -> set[int]:
        rest = [x for x in sets if not x & dealt and count.may_be_unique(x)]
        counts = count(rest) if rest else {}
        return {x for x in sets if x & dealt and not any(a & x == x for a in agree)} | {x for x in rest if counts[x] == count.rows}

    return by_validation(unique, n, agree, most)


def discover_uccs(
    df: DataFrame, columns: list[str] | None = None, id_col: str | None = None, method: str = "levels",
    most: int | None = None, null_equals_null: bool = True, pair_plan: str = "counts",
) -> DataFrame:
    """All minimal column sets whose values are unique. In a table of at
    most one row the empty set is unique. Methods as for FDs."""
    columns = attributes(df, columns, id_col)
    df = df.select(*columns).persist()
    try:
        count = Counter(df, columns, null_equals_null)
        if method == "levels" or count.rows <= 1:
            found = by_levels(count, len(columns), most)
        elif method == "difference":
            found = invert_for_keys(agree_sets(df, columns, pair_plan, null_equals_null), len(columns), most)
        elif method == "hybrid":
            if len(columns) <= WORD and count.by_shards(len(columns)):
                found = by_shards(count, len(columns), most)
            else:
                unique = lambda sets: {x for x, c in count(sets).items() if c == count.rows}
                found = by_validation(unique, len(columns), sampled_agree_sets(df, columns, count.rows, null_equals_null), most)
        else:
            raise ValueError(f"unknown method: {method}")
    finally:
        df.unpersist()
    rows = sorted((names(x, columns), x.bit_count()) for x in found)
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def check_uccs(df: DataFrame, candidates: list[list[str]], null_equals_null: bool = True) -> DataFrame:
    """columns, count, unique for each candidate."""
    every = sorted({c for s in candidates for c in s})
    at = {c: 1 << i for i, c in enumerate(every)}
    count = Counter(df, every, null_equals_null)
    masks = [sum(at[c] for c in s) for s in candidates]
    counts = count(masks)
    rows = [(",".join(s), counts[m], counts[m] == count.rows) for s, m in zip(candidates, masks)]
    return df.sparkSession.createDataFrame(rows, "columns string, n_distinct bigint, is_unique boolean")
