"""Rows of a caller that travel as one value, so that their column names cannot clash with an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def packed(columns: list[str]) -> Column:
    """The columns as one struct named ``row``."""
    return F.struct(F.lit(0).alias("f"), *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(columns)]).alias("row")


def unpacked(columns: list[str]) -> list[Column]:
    """The columns of ``row`` again, under their names."""
    return [F.col(f"row.f{i}").alias(c) for i, c in enumerate(columns)]
