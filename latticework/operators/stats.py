"""Statistics of column partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.kernels import Counter
from ..sources.tables import attributes


def column_set_counts(df: DataFrame, sets: list[list[str]], null_equals_null: bool = True) -> DataFrame:
    """column_set, n_distinct for each set, counted in batches."""
    every = sorted({c for s in sets for c in s})
    at = {c: 1 << i for i, c in enumerate(every)}
    count = Counter(df, every, null_equals_null)
    masks = [sum(at[c] for c in s) for s in sets]
    counts = count(masks)
    return df.sparkSession.createDataFrame([(",".join(s), counts[m]) for s, m in zip(sets, masks)], "column_set string, n_distinct bigint")


def column_partition(df: DataFrame, column: str, id_col: str, stripped: bool = False) -> DataFrame:
    """value, ids, n: the rows of each value; ``stripped`` leaves single rows out."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.array_sort(F.collect_list(id_col)).alias("ids"), F.count("*").alias("n"))
    return out.filter("n > 1") if stripped else out


def partition_stats(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """column_set, n_rows, n_classes, n_stripped_rows, n_stripped_classes, error, score.

    error: rows that would have to go for the set to be unique, over rows in
    classes of several; score: sum of squared class sizes."""
    parts = []
    for s in sets:
        classes = df.groupBy(*s).agg(F.count("*").alias("n"))
        many = lambda c: F.coalesce(F.sum(F.when(F.col("n") > 1, c)), F.lit(0)).cast("bigint")
        stats = classes.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"), F.count("*").alias("n_classes"),
            many(F.col("n")).alias("n_stripped_rows"), many(F.lit(1)).alias("n_stripped_classes"),
            F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("bigint").alias("score"),
        )
        parts.append(stats.select(F.lit(",".join(s)).alias("column_set"), "n_rows", "n_classes", "n_stripped_rows", "n_stripped_classes", (F.col("n_stripped_rows") - F.col("n_stripped_classes")).alias("error"), "score"))
    return reduce(DataFrame.unionByName, parts)


def interestingness(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """column_set, score for each set; the empty set's score is the square of the rows."""
    parts = []
    for s in sets:
        classes = df.groupBy(*s).agg(F.count("*").alias("n")) if s else df.agg(F.count("*").alias("n"))
        parts.append(classes.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("bigint").alias("score")).select(F.lit(",".join(s)).alias("column_set"), "score"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column_set string, score bigint")
    return reduce(DataFrame.unionByName, parts)


def column_overlap(df: DataFrame, a: str, b: str, other: DataFrame | None = None) -> DataFrame:
    """column_a, column_b, overlap: the shared part of two multisets of values,
    sum of the smaller counts over sum of the larger."""
    x = df.groupBy(F.col(a).alias("va")).agg(F.count("*").alias("na"))
    y = (df if other is None else other).groupBy(F.col(b).alias("vb")).agg(F.count("*").alias("nb"))
    both = x.join(y, F.col("va").eqNullSafe(F.col("vb")), "full")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return both.agg((F.sum(F.least(na, nb)) / F.sum(F.greatest(na, nb))).alias("overlap")).select(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), "overlap")


def likeness(df: DataFrame, a: str, b: str) -> tuple[float, float]:
    """(overlap of the values, ratio of the smaller to the larger mean)."""
    overlap = column_overlap(df, a, b).collect()[0]["overlap"] or 0.0
    try:
        row = df.agg(F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))).collect()[0]
    except Exception:  # no numbers: no means to compare
        return overlap, 0.0
    if row[0] is None or row[1] is None or not row[0] or not row[1]:
        return overlap, 0.0
    ratio = min(row[0] / row[1], row[1] / row[0])
    return overlap, max(0.0, ratio)


def size_of(df: DataFrame, columns: list[str] | None = None) -> int:
    """Pairs of rows that agree on all the columns: sum of n (n - 1) / 2 over classes."""
    classes = df.groupBy(*attributes(df, columns)).agg(F.count("*").alias("n"))
    return classes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).collect()[0][0]
