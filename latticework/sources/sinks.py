"""Writing result tables, and joining results of several runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def write_result(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """A result as Parquet, JSON lines or CSV with a header."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def union_of_results(results: list[DataFrame]) -> DataFrame:
    """The distinct rows of several results."""
    return reduce(DataFrame.unionByName, results).distinct()
