"""Written intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shipping import ship


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it
    is unset and the session runs in one local process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="latticework-")
    spark.conf.set("spark.checkpoint.dir", root)
    atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the folder is the cluster's to clean
        return


#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_bytes(source: DataFrame, column: str) -> int:
    """Bytes of a text or binary column, by one scan."""
    return source.agg(F.sum(F.octet_length(column).cast("long"))).collect()[0][0] or 0


def shards_of(spark: SparkSession, total: int, each: int, least: int = 1) -> int:
    """How many shards of about ``each`` hold ``total``. A small total is dealt
    over the session's shuffle partitions, in shards of ``each`` / 8 at least."""
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // each), min(wide, -(-8 * total // each)))


class Scratch:
    """Tables of one operator call. ``keep`` writes a DataFrame as Parquet and
    reads it back, so lost executors never cost more than one step; ``drop``
    removes a table that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_remove, spark, self.base)

    def keep(self, df: DataFrame) -> DataFrame:
        """The shuffle files of the write go as soon as it has ended: nothing reads them again."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, t._scratch_path)
