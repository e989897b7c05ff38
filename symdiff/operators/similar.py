"""All pairs of similar sets: Jaccard similarity of at least a percentage, exactly, through an inverted index.

1. Equal sets are one class, which its least id stands for, so copies never meet one another.
2. Elements are ordered by how many classes hold them, the rarest first. Two sets that are similar share one of their first
   n - ceil(percent * n / 100) + 1 elements (of n): only this prefix goes into the index.
3. Lists of the index are cut by size: sets fall into size classes so wide that similar ones are in the same or
   the next class, and only these are joined. A list of a class that is longer than LIST is dealt into a grid of parts, every part of which
   meets every other in a task of its own.
4. Places in the prefixes bound how much two sets can share; what is left is counted on the whole sets.

Nothing is dropped or capped, so the pairs are all pairs; the work follows the number of pairs that share a rare element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symdiff.plans.tables import settled

#: Sets of a list that meet in one task.
LIST = 1 << 12


def classes(hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, hs, n) of the least document of each class of equal sets, (doc_id, rep)) of hashes (doc_id, h), which may repeat."""
    sets = hashes.where("doc_id is not null and h is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    digest = F.sha2(F.array_join(F.transform("hs", lambda h: F.hex(h)), ","), 256)
    sets = settled(sets.withColumn("digest", digest))
    reps = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = sets.select("doc_id", "digest").join(reps, "digest").select("doc_id", "rep")
    kept = sets.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "hs", F.size("hs").alias("n"))
    return kept, members


def size_class(n: Column, percent: int) -> Column:
    """Two sets of which the smaller has at least percent of the larger one's size are in the same class or in neighbouring ones."""
    if percent == 100:
        return n
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(edges[-1] * 100 // percent + 1)
    return F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= n))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(h, doc_id, n, at): the sets' first elements, the rarest first, with their places."""
    each = sets.select("doc_id", "n", F.explode("hs").alias("h"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("holders"))
    ordered = each.join(counts, "h").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "h"))).alias("all"))
    length = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1).cast("int")
    return ordered.select("doc_id", "n", F.posexplode(F.slice("all", F.lit(1), length)).alias("at", "x")).select(F.col("x.h").alias("h"), "doc_id", "n", "at")


def candidates(index: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets that share an element of their prefixes and may be similar."""
    placed = index.withColumn("level", size_class(F.col("n"), percent))
    left = placed.withColumn("key", F.col("level"))
    right = placed.withColumn("key", F.explode(F.array("level", F.col("level") - 1)))  # with its own class, and with the one below
    parts = [x.groupBy("h", "key").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias(name)) for x, name in ((left, "across"), (right, "down"))]
    grid = parts[0].join(parts[1], ["h", "key"]).where("across > 1 or down > 1")
    part = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        sized = rows.join(grid, ["h", "key"], "left").fillna(1, ["across", "down"])
        return sized.withColumn(f"{own}_part", part(F.col(own))).withColumn(f"{other}_part", every(F.col(other))).drop("across", "down")

    a = dealt(left, "across", "down").select("h", "key", "across_part", "down_part", *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "n", "at", "level")))
    b = dealt(right, "down", "across").select("h", "key", "across_part", "down_part", *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "at", "level")))
    met = a.join(b, ["h", "key", "across_part", "down_part"]).where("level_a < level_b or doc_id_a < doc_id_b")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # shared from this element on, the first that is
    fits = (small * 100 >= large * percent) & (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    return met.where(fits).select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()


def similar_pairs(hashes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """((d1, d2, inter, uni) of the classes whose sets (doc_id, h) have 100 * inter >= percent * uni, d1 < d2; (doc_id, rep) of
    each document's class). Documents without elements are in neither."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    sets, members = classes(hashes)
    sets = settled(sets)
    pairs = candidates(settled(prefixes(sets, percent)), percent)
    one, two = (sets.select(F.col("doc_id").alias(d), F.col("hs").alias(f"h{d}")) for d in "ab")
    both = pairs.join(one, "a").join(two, "b")
    inter = F.size(F.array_intersect("ha", "hb"))
    counted = both.select(F.col("a").alias("d1"), F.col("b").alias("d2"), inter.cast("long").alias("inter"), (F.size("ha") + F.size("hb") - inter).cast("long").alias("uni"))
    return counted.where(F.col("inter") * 100 >= F.col("uni") * percent), members
