"""The package on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_latticework_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    tmp = tempfile.mkdtemp(prefix="latticework-")  # the driver serves it until it ends
    atexit.register(shutil.rmtree, tmp, True)
    tree = Path(tmp, "tree", package.name)
    shutil.copytree(package, tree, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{tmp}/{package.name}", "zip", tree.parent))
    sc._latticework_shipped = True
