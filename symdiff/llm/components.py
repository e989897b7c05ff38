"""Connected components of a distributed edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.llm.common import spread_join, written

#: Edges of a node that meet in one task.
BLOCK = 512


def priority(column) -> F.Column:
    """A fixed random order of ids. Stars whose hub comes first in it are contracted in one round."""
    return F.struct(F.xxhash64(column, F.lit(0)).alias("h"), column.alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the component's smallest id.

    Each round, every node joins the first of its neighbours and itself by priority, edges are renamed to the joined
    nodes, and loops and copies of edges go. The order is random, so no numbering of ids makes long chains. A hub's
    edges are aggregated before they are shuffled, and dealt to several tasks where they are renamed.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct())
    steps = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(priority(F.col("b"))).alias("least"), F.count(F.lit(1)).alias("count"))
        step = written(best.select(F.col("a").alias("id"), F.least("least", priority(F.col("a")))["v"].alias("to"), "count"))
        heavy = written(step.where(F.col("count") > BLOCK).select("id", "count"))
        ends = left
        for side, to in (("a", "x"), ("b", "y")):
            ends = spread_join(ends, step.select(F.col("id").alias(side), F.col("to").alias(to)), side, BLOCK, heavy.withColumnRenamed("id", side))
        left = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        steps.append(step.drop("count"))
    if not steps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left")
        out = out.select("id", F.coalesce("next", "to").alias("to"))
    least = out.groupBy("to").agg(F.min("id").alias("component"))
    return written(out.join(least, "to").select("id", "component"))


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components `found` (id, component) after more links (a, b)."""
    ids = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    every = found.unionByName(ids.join(found, "id", "left_anti").select("id", F.col("id").alias("component")))
    named = links.join(every.select(F.col("id").alias("a"), F.col("component").alias("x")), "a")
    named = named.join(every.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
    merged = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = every.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    return written(out.select("id", F.coalesce("to", "component").alias("component")))
