"""Exact dedup by content-defined chunk recipes, with built-in functions only.

Every text is cut where its content says so (a sentence end or line end after
``MIN_CHUNK`` characters, ``MAX_CHUNK`` at most), so the pieces of a copy are
the pieces of its original. A chunk is named by a 64-bit hash; the name is
verified against the chunk's SHA-256 over the whole corpus, and names that two
contents share are replaced by the digest. Texts are equal when their ordered
lists of verified names are equal. Texts never leave the task that reads them:
only names, digests and recipes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

MIN_CHUNK = 512
MAX_CHUNK = 4096


def chunks(text):
    """The content-defined pieces of a text column, in order; their
    concatenation is the text. Empty text: no pieces."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[.!?\n]|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, SHA-256 of the text, names and digests
    of its chunks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), chunks(text).alias("cut"))
    return cut.select(
        "doc_id",
        "text_sha256",
        F.transform("cut", lambda c: F.xxhash64(c)).alias("names"),
        F.transform("cut", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )


def ambiguous_names(table: DataFrame) -> DataFrame:
    """Names that stand for two contents. 64-bit names of n distinct chunks
    collide n * n / 2 ** 65 times, so a few hundred at 100 TB and none in
    smaller corpora: the one list the plan embeds as a scalar."""
    pairs = table.select(F.explode(F.arrays_zip("names", "digests")).alias("c")).select("c.names", "c.digests")
    return (
        pairs.groupBy("names", "digests").agg(F.lit(1).alias("one"))
        .groupBy("names").agg(F.count("*").alias("contents"))
        .filter("contents > 1").select("names")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Null text counts as empty; empty texts are equal to each other. Of equal
    texts the largest id stays. Rows that repeat an id and its text are one
    document listed twice: each is counted and each gets the same verdict. A
    null id never stays while another id has the text; alone, it is its own
    keep_id (null) and stays. An empty table gives no rows; other columns are
    not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    table = scratch.keep(recipes(docs, id_col, text_col))
    doubtful = ambiguous_names(table).agg(F.collect_list("names").alias("names"))
    bad = [r["names"] for r in doubtful.collect()][0]
    named = table.select(
        "doc_id",
        "text_sha256",
        F.when(
            F.arrays_overlap("names", F.array(*[F.lit(x).cast("long") for x in bad]).cast("array<bigint>")),
            F.transform(
                F.arrays_zip("names", "digests"),
                lambda c: F.struct(
                    c["names"].alias("name"),
                    F.when(c["names"].isin(bad), c["digests"]).alias("digest"),
                ),
            ),
        ).alias("resolved") if bad else F.lit(None).cast("array<struct<name:bigint,digest:binary>>").alias("resolved"),
        "names",
    ).withColumn("recipe_hash", F.xxhash64("names"))
    key = ["recipe_hash", "names", "resolved"]
    groups = named.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    g, n = groups.alias("g"), named.alias("n")
    same = [F.col("n.recipe_hash") == F.col("g.recipe_hash"), F.col("n.names") == F.col("g.names"), F.col("n.resolved").eqNullSafe(F.col("g.resolved"))]
    joined = n.join(g, same[0] & same[1] & same[2])
    return joined.select(
        "n.doc_id", "g.keep_id", "g.group_size",
        F.col("n.doc_id").eqNullSafe(F.col("g.keep_id")).alias("kept"),
        "n.text_sha256",
    )
