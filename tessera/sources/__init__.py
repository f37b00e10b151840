"""Scans and conversions: tables, pages of tables, SQL text, series, literal rows, files, Arrow."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import nulls_last

#: Formats that Spark reads by itself.
FORMATS = ("parquet", "orc", "json", "csv", "text")


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A file scan; columns and filter reach the reader."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    df.write.format(fmt).options(**options).mode(mode).partitionBy(*partition_by).save(path)


def page(df: DataFrame, order: Sequence[str], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Rows offset to offset + limit in an order that must be unique to be repeatable; None is no limit."""
    out = df.orderBy(*(nulls_last(c) for c in order))
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """The table, or no rows of its schema if there is no such table."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def text_scan(spark: SparkSession, name_or_sql: str) -> DataFrame:
    """A query's text is run, a name is scanned."""
    return spark.sql(name_or_sql) if name_or_sql.lstrip()[:6].upper() in ("SELECT", "WITH") or name_or_sql.lstrip()[:6].upper().startswith("WITH ") else spark.table(name_or_sql)


def series(spark: SparkSession, a: int, b: int | None = None, step: int = 1, name: str = "range") -> DataFrame:
    """range(n) or range(a, b): a column of integers, without the end."""
    return (spark.range(a) if b is None else spark.range(a, b, step)).select(F.col("id").alias(name))


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame) -> pa.Table:
    """For results that fit the client; others are written."""
    return df.toArrow()
