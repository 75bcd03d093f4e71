"""Distinct counts of many column sets from few shuffles.

Rows that agree on a column set agree on each of its columns. So if rows are dealt
out by the values of one column, all sets that contain it are counted shard by
shard, and their counts are the sums. A shard refines the classes of equal rows
column by column, along a tree of the sets; rows that stand alone leave it, as they
stand alone in every larger set too.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ..functions.masks import bits, hitting_sets, maximal
from ..sources.shipping import ship

PLAIN = (NumericType, StringType, BooleanType, DateType, TimestampType, TimestampNTZType, BinaryType)
#: Rows that a shard holds at once.
SHARD_ROWS = 1 << 18
#: A column whose largest group has no more rows deals out any table.
SMALL_GROUP = 1 << 12


def plain(df: DataFrame) -> bool:
    """Whether values are equal if and only if their Arrow values are."""
    return all(isinstance(f.dataType, PLAIN) and getattr(f.dataType, "collation", "UTF8_BINARY") == "UTF8_BINARY" for f in df.schema)


def comparable(df: DataFrame) -> DataFrame:
    """-0.0 and NaNs as Spark's groups see them."""
    return df.select(*[
        F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c + F.lit(0.0)).cast(t).alias(n) if t in ("double", "float") else c.alias(n)
        for n, t, c in ((n, t, F.col(f"`{n}`")) for n, t in df.dtypes)
    ])


def column_groups(keys: DataFrame, at_once: int) -> dict[int, tuple[int, int]]:
    """For each column the number of its values and the rows of the most frequent one."""
    out = {}
    for at in range(0, len(keys.columns), at_once):
        part = range(at, min(at + at_once, len(keys.columns)))
        names = [f"k{i}" for i in part]
        source = keys.select(*[F.col(f"`{keys.columns[i]}`").alias(f"k{i}") for i in part])
        groups = source.groupingSets([[c] for c in names], *names).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
        found = {r["gid"]: (r["n"], r["most"]) for r in groups.groupBy("gid").agg(F.count("*").alias("n"), F.max("n").alias("most")).collect()}
        every = (1 << len(names)) - 1
        out |= {i: found[every & ~(1 << (len(names) - 1 - k))] for k, i in enumerate(part)}
    return out


def dealing(groups: dict[int, tuple[int, int]], rows: int) -> list[int]:
    """The columns that deal rows out evenly, those with the most values first."""
    most = max(SMALL_GROUP, min(SHARD_ROWS, rows // 8))
    return sorted((i for i, (_, largest) in groups.items() if largest <= most), key=lambda i: (-groups[i][0], i))


def classes(columns: list[np.ndarray], sets: Iterable[tuple[int, ...]]):
    """For each set of columns, which are given as codes from 0: the set, the rows
    that are equal to others in it, their classes, and how many rows stand alone."""
    sizes = [int(c.max()) + 1 if len(c) else 1 for c in columns]
    # the same for each column of the set before
    path: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    n = len(columns[0])
    for s in sorted(sets):
        depth = 0
        while depth < min(len(path), len(s)) and path[depth][0] == s[depth]:
            depth += 1
        del path[depth:]
        for c in s[depth:]:
            _, row, own, alone = path[-1] if path else (None, np.arange(n), np.zeros(n, np.int64), 0)
            key = pa.array(own * sizes[c] + columns[c][row]).dictionary_encode()
            own = key.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            several = np.bincount(own, minlength=1) > 1
            stay = several[own]
            number = np.cumsum(several) - 1
            path.append((c, row[stay], number[own[stay]], alone + int(len(own) - stay.sum())))
        yield s, *path[-1][1:]


def refined(columns: list[np.ndarray], sets: Iterable[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
    """The distinct rows of each set of columns, which are given as codes from 0."""
    return {s: alone + (int(own.max()) + 1 if len(own) else 0) for s, _, own, alone in classes(columns, sets)}


def _codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal values as equal numbers from 0, a null as 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _counted(sets: dict[int, dict[tuple[int, ...], int]]):
    def run(table: pa.Table) -> pa.Table:
        base = table.column("_base")[0].as_py()
        wanted = sets[base]
        codes = [_codes(table.column(f"k{k}")) for k in range(table.num_columns - 2)]
        found = refined(codes, wanted)
        return pa.table([pa.array([wanted[s] for s in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["set", "n"])

    return run


def sharded_counts(keys: DataFrame, masks: list[int], base_of: dict[int, int], order: list[int], rows: int) -> dict[int, int]:
    """Distinct value combinations of each set over ``keys`` (nulls equal nulls).
    ``base_of``: the column of each set by which rows are dealt out for it;
    ``order``: all columns, those with the most values first."""
    spark = keys.sparkSession
    ship(spark)
    used = sorted(set(bits(reduce(int.__or__, masks))))
    place = {c: used.index(c) for c in used}
    sets: dict[int, dict[tuple[int, ...], int]] = {}
    for number, m in enumerate(masks):
        b = base_of[m]
        sets.setdefault(b, {})[(place[b], *(place[c] for c in order if c != b and m >> c & 1))] = number
    shards = max(-(-2 * rows // SHARD_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SMALL_GROUP)), 1)
    source = comparable(keys.select(*[F.col(f"`{keys.columns[c]}`").alias(f"k{place[c]}") for c in used]))
    dealt = [source.select(F.lit(b).alias("_base"), F.pmod(F.xxhash64(f"k{place[b]}"), F.lit(shards)).cast("int").alias("_shard"), "*") for b in sets]
    every = reduce(DataFrame.unionByName, dealt).repartition(shards * len(sets), "_base", "_shard")
    parts = every.groupBy("_base", "_shard").applyInArrow(_counted(sets), "set int, n long")
    return {masks[r["set"]]: r["n"] for r in parts.groupBy("set").agg(F.sum("n").alias("n")).collect()}


def repeated(columns: list[np.ndarray]) -> set[int]:
    """Agree sets (bits are places in ``columns``) of pairs of rows that are equal in
    the first column, so many that a set with this column is unique if and only if
    none of them contains it.

    Smallest sets that no known agree set contains are tried; where rows are equal in
    one, neighbours in its classes give more agree sets, until all sets tried are unique."""
    every = (1 << len(columns)) - 1
    found: set[int] = set()
    unique: set[int] = set()
    while todo := [x for x in hitting_sets([every & ~a for a in found]) if x not in unique]:
        for s, row, own, _ in classes(columns, [(0, *bits(x)) for x in todo]):
            if not len(row):
                unique.add(sum(1 << c for c in s[1:]))
                continue
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            a, b = row[order[1:][same]], row[order[:-1][same]]
            agree = np.zeros(len(a), np.int64)
            for k, c in enumerate(columns):
                agree |= (c[a] == c[b]).astype(np.int64) << k
            found |= set(np.unique(agree).tolist())
        found = set(maximal(found))
    return found


def _repeated(places: dict[int, list[int]]):
    def run(batches):
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.concat_tables(parts)
        base = table.column("_base").to_numpy()
        for b in np.unique(base).tolist():
            own = table.filter(pa.array(base == b))
            found = repeated([_codes(own.column(f"k{k}")) for k in places[b]])
            masks = [sum(1 << places[b][k] for k in bits(a)) for a in found]
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int64())], ["agree"])

    return run


def sharded_agree_sets(keys: DataFrame, bases: list[int], order: list[int], rows: int) -> set[int]:
    """Agree sets of pairs of rows over ``keys`` (nulls equal nulls; 62 columns at
    most), so many that a set with a column of ``bases`` is unique if and only if none
    of them contains it. One job: rows are dealt out by each of ``bases``, with the
    columns that are not dealt by before, and each shard searches on its own.
    ``order``: all columns, those with the most values first."""
    spark = keys.sparkSession
    ship(spark)
    shards = max(-(-2 * rows // SHARD_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SMALL_GROUP)), 1)
    source = comparable(keys.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys.columns)]))
    places, dealt = {}, []
    for at, b in enumerate(bases):
        places[b] = [b, *(c for c in order if c != b and c not in bases[:at])]
        own = [F.col(f"k{i}") if i in places[b] else F.lit(None).cast(f.dataType).alias(f"k{i}") for i, f in enumerate(source.schema)]
        dealt.append(source.select(F.lit(b).alias("_base"), F.pmod(F.xxhash64(f"k{b}"), F.lit(shards)).cast("int").alias("_shard"), *own))
    parts = reduce(DataFrame.unionByName, dealt).repartition(shards * len(bases), "_base", "_shard")
    return {r["agree"] for r in parts.mapInArrow(_repeated(places), "agree long").distinct().collect()}
