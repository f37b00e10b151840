"""Connected components by contraction, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node and component (its smallest node), for each node of the links (columns a and b).

    Each round gives every node the first of its neighbours and itself in an order by hash as parent, goes on to the parent's parent, and replaces the links by
    those between different parents, until none is left. The order is a new one in each round, so that long chains shrink by a part of their length in
    every round, whatever their numbers are. Rounds are written to shared storage; nothing but "is any left" comes to the driver. First neighbours
    are pre-aggregated, so a node with very many links is no burden.
    """
    scratch = scratch or Scratch(links.sparkSession)
    apart = F.col("a") < F.col("b")
    edges = scratch.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(apart).distinct())
    label, rounds = None, [edges]
    while label is None or not edges.isEmpty():
        first = lambda node: F.struct(F.xxhash64(node, F.lit(len(rounds))).alias("order"), F.col(node).alias("node"))  # noqa: E731, B023
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
        parent = both.groupBy("node").agg(F.min(first("other")).alias("other")).select("node", F.least("other", first("node"))["node"].alias("parent"))
        above = parent.toDF("parent", "grand")
        parent = scratch.write(parent.join(above, "parent").select("node", F.col("grand").alias("parent")))
        if label is None:
            label = parent.toDF("node", "root")
        else:
            up = parent.toDF("root", "parent")
            label = label.join(up, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        label = scratch.write(label)
        ends = edges.join(parent.toDF("a", "pa"), "a").join(parent.toDF("b", "pb"), "b")
        edges = scratch.write(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where(apart).distinct())
        rounds += [parent, label, edges]
    smallest = label.groupBy("root").agg(F.min("node").alias("component"))
    out = scratch.write(label.join(smallest, "root").select("node", "component"))
    scratch.drop(*rounds)
    return out
