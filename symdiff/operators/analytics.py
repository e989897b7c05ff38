"""Summaries of runs: grouped means with the best setting, percentiles, histograms, sweeps, collision and decoding rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symdiff.functions.hashing import SEEDS, low_bits, murmur64a, murmur64a_numpy, trailing_zeroes
from symdiff.functions.unsigned import wrapping
from symdiff.operators import iblt, strata


def group_means(df: DataFrame, group: str, setting: str, metric: str, low: float, high: float) -> DataFrame:
    """(group, setting, mean) of settings within bounds."""
    return df.where(F.col(setting).between(low, high)).groupBy(group, setting).agg(F.avg(metric).alias("mean"))


def best_setting(means: DataFrame, group: str, setting: str) -> DataFrame:
    """(group, best, least): the setting with the least mean, the smallest one of equals."""
    least = F.min(F.struct("mean", setting)).alias("m")
    return means.groupBy(group).agg(least).select(group, F.col(f"m.{setting}").alias("best"), F.col("m.mean").alias("least"))


def high_percentile(df: DataFrame, group: str, metric: str, share: float = 0.999) -> DataFrame:
    return df.groupBy(group).agg(F.percentile(metric, F.lit(share)).alias("p"))


def histogram(df: DataFrame, group: str, value: Column, edges: list[float]) -> DataFrame:
    """(group, bin, n): bins from edge to edge; the last one holds its upper edge as well."""
    bin_ = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        inside = (value >= edges[k]) & ((value <= edges[k + 1]) if k == len(edges) - 2 else (value < edges[k + 1]))
        bin_ = F.when(inside, k).otherwise(bin_)
    return df.select(group, bin_.alias("bin")).where("bin is not null").groupBy(group, "bin").agg(F.count("*").alias("n"))


def sweep(configs: DataFrame, start: int, end: Column, step: int) -> DataFrame:
    """Every configuration with each setting from start to end."""
    return configs.withColumn("block_size", F.explode(F.sequence(F.lit(start).cast("long"), end.cast("long"), F.lit(step).cast("long"))))


def collision_rate(keys: DataFrame, bits: int, seeds: int) -> DataFrame:
    """(seed, keys, distinct_hashes) of hashes cut to so many bits."""
    with wrapping(keys.sparkSession):
        each = F.array(*(F.struct(F.lit(i).alias("seed"), low_bits(murmur64a(F.col("key"), SEEDS[i]), bits).alias("h")) for i in range(seeds)))
        rows = keys.select(F.explode(each).alias("x"))
        return rows.groupBy("x.seed").agg(F.count("*").alias("keys"), F.countDistinct("x.h").alias("distinct_hashes"))


def zero_histogram(keys: DataFrame) -> DataFrame:
    """(ntz, n): how many keys' hashes end in so many zeroes."""
    with wrapping(keys.sparkSession):
        hashed = keys.select(trailing_zeroes(murmur64a(F.col("key")), 64).alias("ntz"))
        return hashed.groupBy("ntz").agg(F.count("*").alias("n"))


def fill_ratios(spark: SparkSession, cells: int, k: int, sizes: list[int], trials: int) -> DataFrame:
    """(keys, fill_ratio, percent_peeled): the mean share of keys that tables of different fill give back."""
    grid = spark.createDataFrame([(n, t) for n in sizes for t in range(trials)], "keys long, trial long").repartition(len(sizes) * trials)
    spec = iblt.Spec(cells, k)

    def work(batches):
        for rows in batches:
            out = []
            for n, t in zip(rows["keys"], rows["trial"], strict=True):
                keys = murmur64a_numpy(np.arange(n, dtype=np.uint64), int(t) + 1)
                at = np.concatenate([i * spec.per_sub + (murmur64a_numpy(keys, SEEDS[i + 1]) % np.uint64(spec.per_sub)).astype(np.int64) for i in range(k)])
                sums, checks, counts = np.zeros(spec.m, np.uint64), np.zeros(spec.m, np.uint64), np.zeros(spec.m, np.int64)
                np.bitwise_xor.at(sums, at, np.tile(keys, k))
                np.bitwise_xor.at(checks, at, np.tile(murmur64a_numpy(keys, SEEDS[0]), k))
                np.add.at(counts, at, 1)
                place = np.arange(spec.m)
                found, _ = iblt.peeled(place // spec.per_sub, place % spec.per_sub, sums.view(np.int64), checks.view(np.int64), counts, spec)
                out.append((n, t, 100.0 * len(found) / n))
            yield pd.DataFrame(out, columns=["keys", "trial", "percent"])

    each = grid.mapInPandas(work, "keys long, trial long, percent double")
    return each.groupBy("keys").agg(F.avg("percent").alias("percent_peeled")).withColumn("fill_ratio", F.col("keys") / F.lit(float(cells)))


def report(runs: DataFrame, what: str, setting: str, **metrics: str) -> DataFrame:
    """(what, setting, runs, metric...): of runs (what, setting, ...), each metric's mean, a row for each point of the report's curves."""
    return runs.groupBy(what, setting).agg(F.count("*").alias("runs"), *(F.avg(column).alias(name) for name, column in metrics.items()))


def strata_accuracy(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """(actual, estimate, ratio): estimators of sets that share nothing, of each size."""
    rows = []
    for n in sizes:
        a, b = (spark.range(n).select((F.col("id") * 2 + side).alias("key")) for side in (0, 1))
        rows.append((2 * n, strata.estimate(a, b)))
    return spark.createDataFrame([(n, e, e / n) for n, e in rows], "actual long, estimate long, ratio double")
