"""Reconciling two key sets: estimate the difference, size the table, decode, and retry with twice the cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.functions.hashing import murmur64a_binary
from symdiff.operators import filesync, iblt, strata
from symdiff.plans.tables import settled

#: Small differences need more cells than twice their size.
LEAST_CELLS = 80


def reconcile(a: DataFrame, b: DataFrame, k: int = 4, cells: int | None = None) -> DataFrame:
    """(side, key): A for keys of a alone, B for keys of b alone."""
    a, b = settled(a), settled(b)
    m = cells or max(2 * strata.estimate(a, b), LEAST_CELLS)
    while True:
        spec = iblt.Spec(m, k)
        found, complete = iblt.decode(iblt.difference_table(a, b, spec), spec)
        if complete:
            return found
        m *= 2


def reconcile_directories(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(side, path) of the entries of two manifests that only one of them has, by sketches of their 40-byte keys."""
    named = [settled(filesync.manifest_keys(x).distinct().withColumn("hash", murmur64a_binary("key"))) for x in (mine, theirs)]
    cells, k = filesync.directory_cells(strata.estimate(*(x.select("key") for x in named)))
    found = reconcile(*(x.select(F.col("hash").alias("key")).distinct() for x in named), k, max(cells, LEAST_CELLS))
    sides = [x.join(found.where(F.col("side") == s).select(F.col("key").alias("hash")), "hash", "left_semi").select(F.lit(s).alias("side"), "path") for s, x in zip("AB", named, strict=True)]
    return sides[0].unionByName(sides[1])
