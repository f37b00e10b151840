"""Explicit partitioning of a Parquet table by its rows' places: row groups, ranges, modulo; one partition for small tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans import ROW_GROUP

ROW, ROWS, PART = "__row", "__rows", "__part"


def with_row(df: DataFrame) -> DataFrame:
    """Adds __row, the dense place of each row over all files in order of their paths, and __rows, how many rows there are.

    ``df`` has the column _metadata of its scan and may be filtered: places count all rows of the files. Spark knows a row's place in its file; what is
    before the file comes from the row counts in the files' footers, one row per file. That is always broadcast: by size Spark takes it for as large as the
    table, and would then send all rows of a file to one task.
    """
    files = df.sparkSession.read.schema("c int").parquet(*df.inputFiles()).groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count(F.lit(1)).alias("__n"))
    every = Window.orderBy("__file")
    before = F.coalesce(F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = files.select("__file", before.alias("__start"), total.alias(ROWS))
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    return placed.join(F.broadcast(starts), "__file").withColumn(ROW, F.col("__start") + F.col("__index")).drop("__file", "__index", "__start")


def in_order(df: DataFrame, groups: dict[str, Column], within: Column, name: str) -> DataFrame:
    """Adds ``name``, each row's place from 1 in the order of the groups (columns and their sort orders) and then of ``within``.

    Rows are numbered in their group; one row per group is summed up over all groups before it. Choose groups of bounded size.
    """
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*groups.values()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(g).alias(f"__{g}") for g in groups), before.alias("__before"))
    numbered = df.withColumn("__at", F.row_number().over(Window.partitionBy(*groups).orderBy(within)))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    return numbered.join(F.broadcast(starts), same).withColumn(name, F.col("__at") + F.col("__before")).select(*df.columns, name)


def rows_of(rows: int | None) -> Column:
    return F.col(ROWS) if rows is None else F.lit(rows)


def range_part(n: int, rows: int | None = None) -> Column:
    """Contiguous ranges of equal size; the last one takes the rest. rows: how many there are, as with_row counts them unless given."""
    each = F.greatest(F.lit(1), F.ceil(rows_of(rows) / n))
    return F.least(F.floor(F.col(ROW) / each), F.lit(n - 1)).cast("int")


def modulo_part(n: int) -> Column:
    return F.pmod(F.col(ROW), F.lit(n)).cast("int")


def aligned_part(n: int, size: int = ROW_GROUP) -> Column:
    """Whole row groups, as many for each of n parts."""
    each = F.greatest(F.lit(1), F.ceil(F.ceil(F.col(ROWS) / size) / n)) * size
    return F.floor(F.col(ROW) / each).cast("int")


def single_part(part: Column, rows: int | None = None, size: int = ROW_GROUP) -> Column:
    """One partition if the table is smaller than a row group."""
    return F.when(rows_of(rows) < size, F.lit(0)).otherwise(part)


def partitioned(df: DataFrame, part: Column) -> DataFrame:
    """Adds __part. Rows stay where the scan puts them; partials are then aggregated per part, so nothing is moved for it."""
    return with_row(df).withColumn(PART, part)


STRATEGIES: dict[str, Callable[[int], Column]] = {
    "row_group": aligned_part,
    "range": range_part,
    "modulo": modulo_part,
    "small": lambda n: single_part(range_part(n)),
}
