"""Values as small numbers: dense ranks and cluster ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import attributes


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A unique number for each row; results never depend on which."""
    return df.withColumn(name, F.monotonically_increasing_id())


def keyed(df: DataFrame, columns: list[str], null_equals_null: bool = True) -> DataFrame:
    """The columns as comparison keys. If nulls differ from each other, a null
    becomes a value of its own row."""
    if null_equals_null:
        return df.select(*columns)
    df = with_row_id(df)
    token = lambda c: F.struct(F.col(c).alias("v"), F.when(F.col(c).isNull(), F.col("_row")).alias("row"))
    return df.select(*[token(c).alias(c) for c in columns])


def distinct_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, rank) with dense ranks from 1, nulls first. Distinct values are
    range-partitioned and numbered by partition offsets, so no task sorts them all."""
    values = df.select(F.col(column).alias("value")).distinct()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = values.repartitionByRange(n, F.col("value").asc_nulls_first()).sortWithinPartitions(F.col("value").asc_nulls_first())
    # the low 33 bits of the id number the rows of a partition in order
    placed = parted.withColumn("_id", F.monotonically_increasing_id()).select(
        "value", F.shiftright("_id", 33).alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")
    )
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row for each shuffle partition
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("nth") + 1).cast("bigint").alias("rank"))


def rank_encoded(df: DataFrame, columns: list[str] | None = None, suffix: str = "_rank", reverse: bool = False) -> DataFrame:
    """``df`` with the dense rank of each column's values; ``reverse`` counts from the largest."""
    for c in attributes(df, columns):
        ranks = distinct_ranks(df, c)
        if reverse:
            most = ranks.agg(F.max("rank")).collect()[0][0] or 0
            ranks = ranks.withColumn("rank", F.lit(most + 1) - F.col("rank"))
        ranks = ranks.withColumnsRenamed({"value": "_value", "rank": f"{c}{suffix}"})
        df = df.join(ranks, F.col(c).eqNullSafe(F.col("_value"))).drop("_value")
    return df


def cluster_encoded(df: DataFrame, columns: list[str] | None = None, suffix: str = "_cluster") -> DataFrame:
    """``df`` with each value's rank as cluster id, and -1 for values that stand once."""
    for c in attributes(df, columns):
        sizes = df.groupBy(F.col(c).alias("_value")).agg(F.count("*").alias("_size"))
        ranks = distinct_ranks(df, c).withColumnRenamed("value", "_v")
        sizes = sizes.join(ranks, F.col("_value").eqNullSafe(F.col("_v"))).select("_value", F.when(F.col("_size") == 1, F.lit(-1)).otherwise(F.col("rank")).cast("bigint").alias(f"{c}{suffix}"))
        df = df.join(sizes, F.col(c).eqNullSafe(F.col("_value"))).drop("_value")
    return df


def shared_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with order-preserving numbers that are comparable across the columns, which are of one type."""
    every = None
    for c in columns:
        part = df.select(F.col(c).alias("value"))
        every = part if every is None else every.union(part)
    ranks = distinct_ranks(every, "value")
    for c in columns:
        df = df.join(ranks.withColumnsRenamed({"value": "_value", "rank": f"{c}_code"}), F.col(c).eqNullSafe(F.col("_value"))).drop("_value")
    return df


def ordered(c: str) -> Column:
    """A column as a key whose order has nulls first."""
    return F.struct(F.col(c).isNotNull().alias("some"), F.col(c).alias("value"))
