"""Partial and final aggregation as two explicit steps, with partial states that merge correctly.

An average is kept as sum and count and divided last; a distinct count as the distinct values themselves; keys and aggregates are told apart by the
plan, not by their names.
"""

from __future__ import annotations

import dataclasses
import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Agg:
    """kind: count, sum, min, max, avg or count_distinct; column: an expression (count: "*" for all rows); name: of the result."""

    kind: str
    column: str
    name: str


def value(a: Agg):
    return F.lit(1) if a.column == "*" else F.expr(a.column)


def partial(df: DataFrame, part: str, keys: Sequence[str], aggs: Sequence[Agg]) -> DataFrame:
    """States per part and key. Distinct values are states, too: there is a row for each of them, and the other states add up over those rows."""
    states, values = [], []
    for a in aggs:
        x = value(a)
        if a.kind == "count_distinct":
            values.append(x.alias(a.name))
            continue
        states += {
            "count": lambda: [F.count(x).alias(a.name)],
            "sum": lambda: [F.sum(x).alias(a.name)],
            "min": lambda: [F.min(x).alias(a.name)],
            "max": lambda: [F.max(x).alias(a.name)],
            "avg": lambda: [F.sum(x).alias(f"{a.name}__sum"), F.count(x).alias(f"{a.name}__n")],
        }[a.kind]()
    groups = df.groupBy(part, *keys, *values)
    return groups.agg(*states) if states else groups.agg(F.lit(1).alias("__one")).drop("__one")


def merge(partials: DataFrame, keys: Sequence[str], aggs: Sequence[Agg]) -> DataFrame:
    out = []
    for a in aggs:
        out.append({
            "count": lambda: F.coalesce(F.sum(a.name), F.lit(0)),
            "sum": lambda: F.sum(a.name),
            "min": lambda: F.min(a.name),
            "max": lambda: F.max(a.name),
            "avg": lambda: F.sum(f"{a.name}__sum").cast("double") / F.nullif(F.sum(f"{a.name}__n"), F.lit(0)),
            "count_distinct": lambda: F.count_distinct(a.name),
        }[a.kind]().alias(a.name))
    return partials.groupBy(*keys).agg(*out)


def two_step(df: DataFrame, part: str, keys: Sequence[str], aggs: Sequence[Agg]) -> DataFrame:
    """Partial per part, then final per key, in one scan (null keys are equal). A second distinct count is worked out beside the first and joined on the keys."""
    distinct = [a for a in aggs if a.kind == "count_distinct"]
    rest = [a for a in aggs if a.kind != "count_distinct"]
    first = [*rest, *distinct[:1]]
    out = merge(partial(df, part, keys, first), keys, first)
    for a in distinct[1:]:
        more = merge(partial(df, part, keys, [a]), keys, [a])
        if not keys:
            out = out.crossJoin(more)  # one row each
            continue
        right = more.select(*(F.col(k).alias(f"__{k}") for k in keys), a.name)
        same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
        out = out.join(right, same).drop(*(f"__{k}" for k in keys))
    return out.select(*keys, *(a.name for a in aggs))


def distinct_merge(df: DataFrame, part: str) -> DataFrame:
    """Distinct rows per part, then over all parts."""
    columns = [c for c in df.columns if c != part]
    return df.select(part, *columns).distinct().select(*columns).distinct()


def concatenate(df: DataFrame, part: str) -> DataFrame:
    """The rows of all parts: they come from one scan, so there is nothing to put together but the part's number to leave out."""
    return df.drop(part)
