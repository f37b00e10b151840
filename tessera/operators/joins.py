"""Joins beyond equality: as-of in buckets of time, and point in interval by bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of a bucket of time.
DAY = 86_400.0
#: Each level's bins are so many times as long as those of the level below.
STEP = 16


def bucket_of(column: str, kind: T.DataType, width: float) -> Column:
    """The bucket of a time (width in seconds) or number."""
    c = F.col(column)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(int(width * 1_000_000)))
    return F.floor(c / F.lit(width))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], width: float = DAY) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time (null if there is none, or if a key or the time is null).

    Both sides are put together and dealt by key and bucket of time, where the last right row is carried forward; one row per key and bucket then carries the
    last right row over the buckets' borders. So a task has a bucket of a key, not all of it. ``width`` is a bucket's length in seconds, or in units of
    a number. Ties between right rows go to the greatest values. ``values`` must not be columns of ``left``.
    """
    none, keys = F.lit(None), [*by, "__bucket"]
    carried = F.struct(F.col(right_time).alias("__at"), *(F.col(v) for v in values))
    kind = right.select(carried.alias("r")).schema["r"].dataType
    bucket = lambda df, t: bucket_of(t, df.schema[t].dataType, width).alias("__bucket")
    l = left.select(*by, bucket(left, left_time), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), none.cast(kind).alias("__r"))
    some = right.dropna(subset=[*by, right_time])
    r = some.select(*by, bucket(right, right_time), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), none.cast(l.schema["__l"].dataType).alias("__l"), carried.alias("__r"))
    here = Window.partitionBy(*keys).orderBy("__t", "__side", F.col("__r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = l.union(r).withColumn("__r", F.last("__r", ignorenulls=True).over(here)).where("__side = 1")
    # every bucket that left rows are in asks for the last right row of the buckets before it
    asked = l.select(*keys).distinct().withColumn("__last", none.cast(kind)).union(r.groupBy(*keys).agg(F.max("__r").alias("__last")))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rangeBetween(Window.unboundedPreceding, -1)
    borders = asked.groupBy(*keys).agg(F.max("__last").alias("__last")).withColumn("__before", F.last("__last", ignorenulls=True).over(earlier)).where("__before is not null")
    out = found.join(borders.select(*keys, "__before"), keys, "left").withColumn("__r", F.coalesce("__r", "__before"))
    return out.select("__l.*", *(F.col("__r")[v].alias(v) for v in values))


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, through an equality join on bins; an interval is in every bin of its level that it touches.

    Level 0 has bins of ``width``, each other level bins STEP times as long as the one below; an interval goes to the first level where it touches STEP + 1
    bins at most, so however long it is, it is copied that often. Points look at the levels that intervals are at; those few numbers are found beforehand.
    Choose the width near the intervals' usual length. Intervals with a null or no length match nothing.
    """
    real = intervals.where(F.col(low) < F.col(high))
    length = (F.col(high) - F.col(low)).cast("double") / F.lit(float(width))
    level = F.greatest(F.lit(0), F.ceil(F.log(float(STEP), length) - F.lit(1))).cast("int")
    real = real.withColumn("__level", level)
    levels = sorted(r[0] for r in real.select("__level").distinct().collect())  # some twenty numbers at most
    size = F.lit(float(width)) * F.pow(F.lit(float(STEP)), F.col("__level"))
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    p = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bin", at(point))
    i = real.withColumn("__bin", F.explode(F.sequence(at(low), at(high))))
    return p.join(i, ["__level", "__bin"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__level", "__bin")
