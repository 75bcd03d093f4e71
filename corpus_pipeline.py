"""The corpus pipeline: five operators in order, each stage written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage judges the rows that its
predecessor kept, and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from latticework.llm.decontam import contained_items
from latticework.llm.line_dedup import dedup_lines
from latticework.llm.mixing import mixed
from latticework.llm.near_dedup import near_duplicates
from latticework.llm.quality import keep_good
from latticework.llm.scratch import Scratch

#: Text that is left without any of these is empty.
INK = r"\S"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand elsewhere first; rows of which nothing is left go."""
    left = dedup_lines(docs, passing=docs.columns).filter(F.col("text").rlike(INK))
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", length).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8)."""
    kept = near_duplicates(docs, words=5, percent=80).filter("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    found = contained_items(docs, _table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("item_ids") == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mixture uses, with the rate and the number of copies."""
    return mixed(docs, _table(spark, sf_dir, "labels")).filter("copies > 0").select(*docs.columns, "tokens", "rate", "copies")


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: No stage but the joins between them can be said in SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
