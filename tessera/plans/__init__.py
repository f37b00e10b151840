"""What a query's plan looks like: whether it could be dealt out task by task, how its parts would be merged, and in which mode.

Read-only: Spark plans and runs every query itself; this reports.
"""

from __future__ import annotations

import dataclasses
import math
import re

from pyspark.sql import DataFrame

#: Rows of a row group, by which tables are cut into tasks; rows that make a partition worthwhile; tasks per worker at most.
ROW_GROUP = 122_880
MIN_ROWS_PER_PARTITION = 100
TASKS_PER_WORKER = 4
SCANS = ("LogicalRelation", "LogicalRDD", "LocalRelation", "Range", "HiveTableRelation", "DataSourceV2ScanRelation", "RelationV2")
DEALABLE = ("Project", "Filter", "Aggregate", *SCANS)


def nodes(plan) -> list[tuple[str, object]]:
    """Name and node of a logical plan and all below it."""
    out = [(plan.nodeName(), plan)]
    children = plan.children()
    for i in range(children.size()):
        out += nodes(children.apply(i))
    return out


def optimized(df: DataFrame) -> list[tuple[str, object]]:
    return nodes(df._jdf.queryExecution().optimizedPlan())


def is_scan(name: str) -> bool:
    return any(name.startswith(s) for s in SCANS)


def contains_scan(df: DataFrame) -> bool:
    return any(is_scan(n) for n, _ in optimized(df))


def passes_text_gate(sql: str) -> bool:
    """Whether the text alone allows dealing out: a SELECT with FROM and without ORDER BY and OFFSET."""
    text = re.sub(r"\s+", " ", sql.strip()).upper()
    return text.startswith("SELECT ") and " FROM " in text and " ORDER BY " not in text and " OFFSET " not in text


def passes_plan_gate(df: DataFrame) -> bool:
    """Whether the plan is only projections, filters and aggregates over scans, each over one input."""
    return all((is_scan(n) or n in DEALABLE) and p.children().size() <= 1 for n, p in optimized(df))


@dataclasses.dataclass(frozen=True)
class Analysis:
    has_aggregation: bool
    has_group_by: bool
    has_distinct: bool
    has_order_by: bool
    has_join: bool
    has_window: bool
    has_cte: bool
    pipelines: int

    @property
    def merge_strategy(self) -> str:
        if self.has_group_by:
            return "GROUP_BY_MERGE"
        if self.has_aggregation:
            return "AGGREGATE_MERGE"
        return "DISTINCT_MERGE" if self.has_distinct else "CONCATENATE"


def analyze(df: DataFrame) -> Analysis:
    """From the analysed plan, where DISTINCT is still its own operator."""
    found = nodes(df._jdf.queryExecution().analyzed())
    names = [n for n, _ in found]
    aggregates = [p for n, p in found if n == "Aggregate"]
    joins = sum(n in ("Join", "AsOfJoin", "LateralJoin") for n in names)
    windows = names.count("Window")
    return Analysis(
        has_aggregation=bool(aggregates),
        has_group_by=any(p.groupingExpressions().size() for p in aggregates),
        has_distinct="Distinct" in names or "Deduplicate" in names,
        has_order_by="Sort" in names,
        has_join=joins > 0,
        has_window=windows > 0,
        has_cte=any(n in ("WithCTE", "CTERelationRef", "UnionLoop", "CTERelationDef") for n in names),
        pipelines=1 + joins + windows,
    )


@dataclasses.dataclass(frozen=True)
class Deal:
    """How rows are dealt to tasks: the mode, the strategy (both are fixed values), and each task's first and last row."""

    mode: str
    strategy: str
    ranges: tuple[tuple[int, int], ...]

    @property
    def tasks(self) -> int:
        return len(self.ranges)


def parallelism(rows: int) -> int:
    """Threads that a scan of so many rows is worth: one for every two row groups."""
    return max(rows // (2 * ROW_GROUP), 1)


def task_count(workers: int, parallelism: int) -> int:
    return min(max(parallelism, workers), TASKS_PER_WORKER * workers)


def deal(rows: int, workers: int, parallelism: int = 1) -> Deal:
    """Row groups if there are enough of them, else ranges; a table of under one row group, or an empty one, is one task."""
    whole = ((0, max(rows - 1, 0)),)
    if workers <= 0:
        return Deal("LOCAL", "NONE", whole)
    n = task_count(workers, parallelism)
    if rows < ROW_GROUP or n <= 1:
        return Deal("DELEGATED", "NONE", whole)
    groups = math.ceil(rows / ROW_GROUP)
    if groups >= n:
        each = math.ceil(groups / n) * ROW_GROUP
        return Deal("ROW_GROUP_PARTITION", "ROW_GROUP_ALIGNED", tuple((a, min(a + each, rows) - 1) for a in range(0, rows, each)))
    each = math.ceil(rows / n)
    return Deal("NATURAL_PARTITION", "NATURAL", tuple((a, min(a + each, rows) - 1) for a in range(0, rows, each)))


def partition_info(rows: int, workers: int) -> dict:
    each = math.ceil(rows / max(workers, 1))
    return {"rows_per_partition": each, "worthwhile": workers > 1 and each >= MIN_ROWS_PER_PARTITION, "row_groups": math.ceil(rows / ROW_GROUP)}


def classify(sql: str, df: DataFrame, rows: int, workers: int) -> Deal:
    """The mode of a query on a table of so many rows."""
    if workers <= 0 or not passes_text_gate(sql) or not passes_plan_gate(df):
        return Deal("LOCAL", "NONE", ((0, max(rows - 1, 0)),))
    return deal(rows, workers, parallelism(rows))
