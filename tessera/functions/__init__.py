"""Column helpers where the host's semantics differ from Spark's: ENUM order, lists, null order, wide results of sums and averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def enum_ordinal(c: str | Column, labels: Sequence[str]) -> Column:
    """The label's place of declaration, from 1; null for null."""
    return F.when(col(c).isNull(), None).otherwise(F.array_position(F.array(*map(F.lit, labels)), col(c)))


def enum_min(c: str | Column, labels: Sequence[str]) -> Column:
    return F.min_by(col(c), enum_ordinal(c, labels))


def enum_max(c: str | Column, labels: Sequence[str]) -> Column:
    return F.max_by(col(c), enum_ordinal(c, labels))


def enum_compare(a: str | Column, op: str, b: str | Column, labels: Sequence[str]) -> Column:
    """Compares by order of declaration."""
    x, y = enum_ordinal(a, labels), enum_ordinal(b, labels)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y, "<>": x != y}[op]


def enum_order(c: str | Column, labels: Sequence[str], descending: bool = False) -> Column:
    return nulls_last(enum_ordinal(c, labels), descending)


def nulls_last(c: str | Column, descending: bool = False) -> Column:
    """The host sorts nulls last in either direction."""
    return col(c).desc_nulls_last() if descending else col(c).asc_nulls_last()


def list_len(c: str | Column) -> Column:
    """Null for a null list."""
    return F.array_size(col(c)).cast("long")


def list_get(c: str | Column, place: int) -> Column:
    """1-based; from the end if negative; null if there is no such place."""
    return F.try_element_at(col(c), F.lit(place)) if place else F.get(col(c), F.lit(-1))


def list_contains(c: str | Column, value) -> Column:
    """False, not null, if the value is absent and the list holds a null; null for a null list or value."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.when(col(c).isNotNull() & value.isNotNull(), F.coalesce(F.array_contains(col(c), value), F.lit(False)))


def unnest(c: str | Column) -> Column:
    return F.explode(col(c))


def octet_length(c: str | Column) -> Column:
    return F.octet_length(col(c)).cast("long")


def sum_whole(c: str | Column) -> Column:
    """A sum of integers that doesn't overflow 64 bits on the way."""
    return F.sum(col(c).cast("decimal(38,0)"))


def sum_money(c: str | Column, scale: int = 2) -> Column:
    return F.sum(col(c).cast(f"decimal(28,{scale})")).cast(f"decimal(38,{scale})")


def avg_double(c: str | Column) -> Column:
    return F.avg(col(c)).cast("double")
