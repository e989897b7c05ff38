"""Gossip over a network: graphs, connectivity, and rounds of exchanging scaled set tables.

What a node has gathered is a linear combination of the origins' tables, so a round works on the combination's
coefficients (node, origin, coefficient) only; cells are computed once at the end. Choices of neighbours and factors are
hashes of round and node, so a run is reproducible. Rounds are synchronous.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.functions.hashing import portable
from symdiff.operators import iblt, multiparty, sets
from symdiff.operators.sets import chance
from symdiff.plans.tables import settled

# Fixed value: the field of the coefficients.
PRIME = 1_000_000_007


def complete_network(nodes: DataFrame) -> DataFrame:
    """(src, dst): every ordered pair of nodes (node); the graph itself has that many edges."""
    others = nodes.select(F.col("node").alias("dst"))
    return nodes.select(F.col("node").alias("src")).join(others, F.col("src") != F.col("dst"))


def random_network(nodes: DataFrame, probability: float, seed: int = 0) -> DataFrame:
    """(src, dst) in both directions: each pair of nodes with the probability."""
    half = complete_network(nodes).where("src < dst").where(chance(seed, F.col("src"), F.col("dst")) < probability)
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def connected_random_network(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """With the probability 2 ln(n) / n, drawn again until it is connected."""
    n = nodes.count()
    while True:
        edges = settled(random_network(nodes, min(1.0, 2 * math.log(max(n, 2)) / max(n, 1)), seed))
        if is_connected(nodes, edges):
            return edges
        seed += 1


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached. Labels spread over edges and over the labels' own labels."""
    labels = settled(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("component").alias("c"))
        step = labels.join(near.withColumnRenamed("src", "node"), "node", "left").select("node", "component", F.least("component", "c").alias("next"))
        step = settled(step)
        jump = step.join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next").select("node", "component", F.least("next", "far").alias("next"))
        jump = settled(jump)
        labels = jump.select("node", F.col("next").alias("component"))
        if jump.where("next <> component").isEmpty():
            return labels


def is_connected(nodes: DataFrame, edges: DataFrame) -> bool:
    return components(nodes, edges).select("component").distinct().count() <= 1


def neighbours(edges: DataFrame, round_: int) -> DataFrame:
    """(node, other): the neighbour that each node turns to in a round."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.min_by("dst", F.xxhash64("src", "dst", F.lit(round_))).alias("other"))


def factor(round_: int):
    """From 1 to PRIME - 1, for each node."""
    return portable(F.col("node"), 1000 + round_) % (PRIME - 1) + 1


def push_pull(state: DataFrame, chosen: DataFrame, round_: int) -> DataFrame:
    """One round: each node sends its state times a factor to its choice and takes the choice's state as it is."""
    pairs = state.join(chosen, "node")
    pushed = pairs.select(F.col("other").alias("node"), "origin", F.pmod(F.col("coefficient") * factor(round_), F.lit(PRIME)).alias("coefficient"))
    pulled = chosen.join(state.withColumnRenamed("node", "other"), "other").select("node", "origin", "coefficient")
    every = state.unionByName(pushed).unionByName(pulled)
    return every.groupBy("node", "origin").agg(F.pmod(F.sum("coefficient"), F.lit(PRIME)).alias("coefficient"))


def run(nodes: DataFrame, edges: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, int]:
    """((node, origin, coefficient), rounds) when every node has something of every origin; an error if that takes too long, as in a
    network that isn't connected."""
    n = nodes.count()
    state = settled(nodes.select("node", F.col("node").alias("origin"), F.lit(1).cast("long").alias("coefficient")))
    for k in range(most_rounds):
        if state.count() == n * n:
            return state, k
        state = settled(push_pull(state, neighbours(edges, k), k))
    if state.count() < n * n:
        raise ValueError(f"after {most_rounds} rounds not every node has heard of every other one")
    return state, most_rounds


def received(state: DataFrame) -> DataFrame:
    """(node, origins): of how many origins each node has received."""
    return state.groupBy("node").agg(F.countDistinct("origin").alias("origins"))


def retrieved(state: DataFrame, memberships: DataFrame, spec: iblt.Spec) -> DataFrame:
    """(node, key, coefficient, ok): what each node decodes, the keys that not all nodes hold. memberships: (node, key).

    A node adds its own table as often as makes all coefficients sum up to 0, which cancels keys that all hold.
    """
    own = state.groupBy("node").agg(F.pmod(-F.sum("coefficient"), F.lit(PRIME)).alias("coefficient")).withColumn("origin", F.col("node"))
    total = state.unionByName(own.select("node", "origin", "coefficient")).groupBy("node", "origin").agg(F.pmod(F.sum("coefficient"), F.lit(PRIME)).alias("coefficient"))
    keys = total.join(memberships.withColumnRenamed("node", "origin"), "origin").select("node", "key", "coefficient")
    return multiparty.decode(multiparty.build(keys, spec, PRIME, 32, "node"), spec, PRIME, 32, "node")


def transmitted(found: DataFrame, memberships: DataFrame, nodes: int) -> DataFrame:
    """(node, missing, percent): the keys that a node doesn't hold, and the share of them that it decoded."""
    partial = memberships.groupBy("key").agg(F.countDistinct("node").alias("holders")).where(F.col("holders") < nodes)
    all_missing = partial.count()
    own = memberships.join(partial, "key").groupBy("node").agg(F.count("*").alias("own"))
    decoded = found.where("key is not null").join(memberships.withColumn("mine", F.lit(1)), ["node", "key"], "left").where("mine is null").groupBy("node").agg(F.count("*").alias("decoded"))
    rows = found.select("node").distinct().join(own, "node", "left").join(decoded, "node", "left")
    missing = F.lit(all_missing) - F.coalesce("own", F.lit(0))
    return rows.select("node", missing.cast("long").alias("missing"), F.when(missing == 0, 100.0).otherwise(100.0 * F.coalesce("decoded", F.lit(0)) / missing).alias("percent"))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """(number, key): keys numbered from 0 in their order."""
    return sets.ranked(df.select(F.col(column).cast("long").alias("key")).distinct(), [], ["key"], "number").select("number", "key")
