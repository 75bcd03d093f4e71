"""Reading tables, and shaping them for discovery."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType, StringType, VariantType

TYPED = re.compile(r"^(.*)\((string|integer|int|long|bigint|double|date|timestamp)\)$", re.I)


def read_table(spark: SparkSession, path: str, kind: str | None = None, header: bool = False, schema=None) -> DataFrame:
    """A Parquet, JSON-lines or CSV table. CSV types are inferred; columns without
    a header are _c0, _c1, ...; a header may carry types as ``name(type)``."""
    kind = kind or next((k for k in ("parquet", "json", "csv") if f".{k}" in path.rsplit("/", 1)[-1]), "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "json":
        return reader.json(path)
    if kind == "csv":
        return typed_header(reader.csv(path, header=header, inferSchema=schema is None))
    raise ValueError(f"unknown kind of table: {kind}")


def typed_header(df: DataFrame) -> DataFrame:
    """Columns named ``name(type)`` become ``name`` of that type; text that is no such value becomes null."""
    cols = []
    for c in df.columns:
        m = TYPED.match(c)
        cols.append(F.col(f"`{c}`").try_cast({"integer": "int", "long": "bigint"}.get(m[2].lower(), m[2].lower())).alias(m[1].strip()) if m else F.col(f"`{c}`"))
    return df.select(*cols)


def sniff_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a whole number become bigint, those whose
    every value is a number double; one pass over the table."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    bad = lambda c, t: F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), 1))
    row = df.agg(*[bad(c, t).alias(f"{c}:{t}") for c in texts for t in ("bigint", "double")]).collect()[0]
    kind = {c: next((t for t in ("bigint", "double") if row[f"{c}:{t}"] == 0), None) for c in texts}
    return df.select(*[F.col(c).cast(kind[c]).alias(c) if kind.get(c) else F.col(c) for c in df.columns])


def part_of(df: DataFrame, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """The first columns, and at most so many rows: a stated part of a table to look at."""
    df = df.select(*df.columns[:columns]) if columns is not None else df
    return df.limit(rows) if rows is not None else df


def attributes(df: DataFrame, columns: list[str] | None = None, id_col: str | None = None) -> list[str]:
    """The columns to look for dependencies in. Maps have no equality and are refused."""
    out = list(columns) if columns is not None else [c for c in df.columns if c != id_col]
    for c in out:
        if isinstance(df.schema[c].dataType, (MapType, VariantType)):
            raise ValueError(f"column {c}: values of this type can't be compared; group or cast them first")
    return out
