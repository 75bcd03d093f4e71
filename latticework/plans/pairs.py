"""Plans that meet every pair of distinct rows, or chosen pairs, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .encode import distinct_ranks

#: Rows of a block of the triangle plan.
BLOCK_ROWS = 2_000


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows as _id, _times and columns _0, _1, ...: what pair plans work
    on. A row's id is its content behind a hash of it, so both sides of a self join
    agree on it, whatever order their rows are in and however often they are made."""
    out = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    out = out.groupBy(*[f"_{i}" for i in range(len(columns))]).agg(F.count("*").alias("_times"))
    content = [F.col(f"_{i}") for i in range(len(columns))]
    return out.withColumn("_id", F.struct(F.xxhash64(*content).alias("hash"), *content))


def agreement_classes(df: DataFrame, columns: list[str], null_equals_null: bool = True) -> DataFrame:
    """The rows as :func:`distinct_rows` has them, as far as they can agree with others:
    a value that stands once in its column agrees with none and is null, other
    values are numbers. So copies of a row that differ in a key are one class."""
    source = out = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        values = source.groupBy(F.col(f"c{i}").alias("v")).agg(F.count("*").alias("n")).filter("n > 1")
        if not null_equals_null:
            values = values.filter("v is not null")
        ranks = distinct_ranks(values, "v").withColumnsRenamed({"value": "_value", "rank": f"r{i}"})
        out = out.join(ranks, F.col(f"c{i}").eqNullSafe(F.col("_value")), "left").drop("_value", f"c{i}")
    return distinct_rows(out, [f"r{i}" for i in range(len(columns))])


def sides(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    left = rows.select(F.col("_id").alias("ida"), F.col("_times").alias("ta"), *[F.col(f"_{i}").alias(f"a{i}") for i in range(n)])
    right = rows.select(F.col("_id").alias("idb"), F.col("_times").alias("tb"), *[F.col(f"_{i}").alias(f"b{i}") for i in range(n)])
    return left, right


def all_pairs(rows: DataFrame, n: int) -> DataFrame:
    """Every unordered pair by one non-equi self join; for small tables. The left side
    is dealt over the session's shuffle partitions, as a few rows are much work."""
    left, right = sides(rows, n)
    left = left.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ida")
    return left.join(right, F.col("ida") < F.col("idb"))


def triangle_pairs(rows: DataFrame, n: int, side: int | None = None) -> DataFrame:
    """Every unordered pair by an equi join on block pairs (i, j), i <= j: rows are
    dealt to ``side`` blocks and copied to the ``side`` block pairs of their
    block. side * (side + 1) / 2 keys spread the work, at ``side`` copies a row."""
    if side is None:
        side = max(1, -(-rows.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("_id"), F.lit(side)).cast("int")
    every = F.sequence(F.lit(0), F.lit(side - 1))
    rows = rows.withColumn("_block", block).withColumn("_other", F.explode(every))
    rows = rows.withColumn("_key", F.least("_block", "_other") * F.lit(side) + F.greatest("_block", "_other"))
    a = rows.select(F.col("_key").alias("ka"), F.col("_block").alias("blka"), F.col("_id").alias("ida"), F.col("_times").alias("ta"), *[F.col(f"_{i}").alias(f"a{i}") for i in range(n)])
    b = rows.select(F.col("_key").alias("kb"), F.col("_block").alias("blkb"), F.col("_id").alias("idb"), F.col("_times").alias("tb"), *[F.col(f"_{i}").alias(f"b{i}") for i in range(n)])
    # inside a block by id; between blocks the lower block is on the left
    meet = (F.col("ka") == F.col("kb")) & F.when(F.col("blka") == F.col("blkb"), (F.col("ida") < F.col("idb")) & (F.col("ka") == F.col("blka") * F.lit(side) + F.col("blka"))).otherwise(F.col("blka") < F.col("blkb"))
    return a.join(b, meet).drop("ka", "kb", "blka", "blkb")


def sharing_pairs(rows: DataFrame, n: int) -> DataFrame:
    """Every unordered pair that agrees somewhere, once: an equi join for each
    column, which takes the pairs that agree in no earlier one. A null agrees with
    none, as in :func:`agreement_classes`."""
    left, right = sides(rows, n)
    out = None
    for i in range(n):
        meet: Column = (F.col(f"a{i}") == F.col(f"b{i}")) & (F.col("ida") < F.col("idb"))
        for j in range(i):
            meet = meet & ~F.coalesce(F.col(f"a{j}") == F.col(f"b{j}"), F.lit(False))
        part = left.join(right, meet)
        out = part if out is None else out.unionByName(part)
    return out


def neighbour_pairs(rows: DataFrame, n: int, distance: int = 1) -> DataFrame:
    """For each column the pairs that stand ``distance`` apart among rows of one
    value: a sample rich in agreements."""
    left, right = sides(rows, n)
    out = None
    for i in range(n):
        order = [F.col(f"_{(i + k) % n}") for k in range(1, n)] + [F.col("_id")]
        after = rows.select("_id", F.lead("_id", distance).over(Window.partitionBy(f"_{i}").orderBy(*order)).alias("_next")).filter("_next is not null")
        out = after if out is None else out.unionByName(after)
    met = out.select(F.least("_id", "_next").alias("ida"), F.greatest("_id", "_next").alias("idb")).distinct()
    return left.join(met, "ida").join(right, "idb")


def partner_pairs(rows: DataFrame, n: int, partners: int = 20, seed: int = 0) -> DataFrame:
    """For each row up to ``partners`` others, chosen by hash of its values: rows are
    dealt ``partners`` times to buckets of about two."""
    count = max(2, rows.count() // 2)
    content = F.xxhash64(*[f"_{i}" for i in range(n)])
    dealt = rows.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(partners))))
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64(content, F.col("_turn"), F.lit(seed)), F.lit(count)))
    met = dealt.select("_turn", "_bucket", F.col("_id").alias("ida")).join(dealt.select("_turn", "_bucket", F.col("_id").alias("idb")), ["_turn", "_bucket"])
    met = met.filter("ida < idb").select("ida", "idb").distinct()
    left, right = sides(rows, n)
    return left.join(met, "ida").join(right, "idb")


PLANS = {"nested": all_pairs, "triangle": triangle_pairs, "sharing": sharing_pairs}
