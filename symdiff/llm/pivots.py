"""Embedding near-duplicates through a pivot-permutation index.

1. A bounded sample of vectors (SAMPLE, by hash of the id) gives reference points no two of which are close: LEAST_PIVOTS
   of them, more with the fourth root of the number of vectors beyond ROWS, at most MOST_PIVOTS.
2. Every vector is described by its permutation: its nearest pivots, in order of nearness (`nearest_of` them).
3. It goes to the inverted lists of all combinations of SHARED of these pivots, with the places that they have in its
   permutation. Vectors that meet there share that many pivots; they are candidates unless the pivots' places differ by
   more than SHIFT permutations' lengths, or their sign sketches (128 random hyperplanes) more than a pair at the
   threshold's do but for a chance of about one in ten million.
4. Candidates are verified by cosine in double precision; links give counts and components.

Dense groups: a list's hub, the vector that comes first in a random order, is the centre of a ball for list members
with similar sketches (in lists of the FIRST pivots); who is within half of the threshold's angle of its first hub belongs to its ball (a vector to one
ball at most, else it is a ball of its own). Members of a ball link with each other without being paired. A list holds
each ball once, and two balls' centres and radii say for most pairs that all or none of their members link. Only for the
others members are paired, by blocks, so nothing is lost when a group is cut into several balls.

Exact copies are one class with a count, which its digest stands for, so a vector that many rows repeat takes part once.
Vectors of a length of which the sample holds none share one list by length.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows
with a null id (their component is null); vectors of different lengths never link; repeated rows count as vectors of
their own, rows of one id with different vectors too, whatever their order; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import math
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdiff.llm.common import in_small_batches, spread_join, written
from symdiff.llm.components import components, priority
from symdiff.llm.minhash import stream

SAMPLE = 8192
ROWS, LEAST_PIVOTS, MOST_PIVOTS = 50_000, 192, 2304
SHARED = 3
SHIFT = 1.25
#: Two pivots' cosine is below this.
APART = 0.7
SKETCH = 128
#: Hubs are looked for in lists of pivots before this place in a permutation.
FIRST = 5
#: Sketches of a hub and a member of its ball differ at most so much; twice of what they do at a cosine of 0.98.
LIKE_HUB = 16
#: Members of a ball that a join deals to one task, and classes of more rows than this are large.
BLOCK = 512
#: Large classes up to this many are sent to every executor (32 bytes each).
BROADCAST_IDS = 500_000


def unit(raw: list | None) -> np.ndarray | None:
    """In double precision; None for vectors that link with nothing."""
    if not raw or None in raw:
        return None
    v = np.array(raw, dtype=np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or not top:
        return None
    v /= top
    return v / np.linalg.norm(v)


def pivot_count(rows: int) -> int:
    return min(MOST_PIVOTS, round(LEAST_PIVOTS * max(1.0, rows / ROWS) ** 0.25))


def nearest_of(pivots: int) -> int:
    """The length of permutations: the more pivots there are, the more easily close vectors' nearest ones differ."""
    return 1 + round(7 * (max(1, pivots) / LEAST_PIVOTS) ** 0.2)


def choose_pivots(vectors: list[np.ndarray], most: int = LEAST_PIVOTS) -> dict[int, np.ndarray]:
    """By vector length."""
    out: dict[int, np.ndarray] = {}
    for n in sorted({len(v) for v in vectors}):
        chosen, count = np.empty((most, n)), 0
        for v in (v for v in vectors if len(v) == n):
            if count < most and (chosen[:count] @ v < APART).all():
                chosen[count] = v
                count += 1
        out[n] = chosen[:count]
    return out


def planes(n: int) -> np.ndarray:
    return np.random.default_rng(n).standard_normal((n, SKETCH))


def largest_difference(angle: Column | float) -> Column | float:
    """Of two sketches at an angle, but for a chance of about 1e-7."""
    p = angle / math.pi
    root = F.sqrt if isinstance(p, Column) else math.sqrt
    return SKETCH * p + 5.3 * root(SKETCH * p * (1 - p)) + 1


def lists_of(permutations: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each permutation: its lists' keys, and the places of a list's pivots in it (a byte each), by rising pivots."""
    n, nearest = permutations.shape
    order = np.argsort(permutations, axis=1)
    pivots = np.take_along_axis(permutations, order, axis=1)
    combos = np.array(list(combinations(range(nearest), min(SHARED, nearest))), dtype=np.int64).reshape(-1, min(SHARED, nearest))
    keys, places = np.full((n, len(combos)), length, dtype=np.uint64), np.zeros((n, len(combos)), dtype=np.int64)
    factors = stream(SHARED, 5) | np.uint64(1)
    for j in range(combos.shape[1]):
        keys = keys * factors[j] + pivots[:, combos[:, j]].astype(np.uint64) + np.uint64(1)
        places = places << 8 | order[:, combos[:, j]]
    return keys.view(np.int64), places


def describe(df: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """(id, digest, keys, places, s1, s2, unit); all but the id are null for vectors that link with nothing."""

    def work(batches):
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            units = [None if i is None else unit(v) for i, v in zip(ids, batch.column(1).to_pylist(), strict=True)]
            keys: list = [None] * len(ids)
            places: list = [None] * len(ids)
            signs = np.zeros((len(ids), 2), dtype=np.int64)
            for n in {len(u) for u in units if u is not None}:
                at = [i for i, u in enumerate(units) if u is not None and len(u) == n]
                some = np.array([units[i] for i in at])
                if n not in drawn:
                    drawn[n] = planes(n)
                signs[at] = np.packbits(some @ drawn[n] > 0, axis=1).view(np.int64).reshape(len(at), 2)
                points = pivots.get(n, np.empty((0, n)))
                found = lists_of(np.argsort(-(some @ points.T), axis=1, kind="stable")[:, : min(nearest, len(points))], n)
                for i, k, p in zip(at, *found, strict=True):
                    keys[i], places[i] = k, p
            data = [None if u is None else u.tobytes() for u in units]
            digests = [None if d is None else blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64())), pa.array(signs[:, 0]), pa.array(signs[:, 1]), pa.array(data, pa.binary())],
                ["id", "digest", "keys", "places", "s1", "s2", "unit"],
            )

    return df.mapInArrow(work, "id long, digest binary, keys array<long>, places array<long>, s1 long, s2 long, unit binary")


def with_cosine(df: DataFrame, keep: list[str]) -> DataFrame:
    """df (keep..., x, y) -> (keep..., cosine) of the unit vectors x and y; -1 for different lengths."""
    schema = df.select(*keep).schema

    def work(batches):
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in "xy")
            n, m = (pc.binary_length(c).to_numpy() for c in (x, y))
            out = np.full(batch.num_rows, -1.0)
            for length in np.unique(n[n == m]):
                at = np.flatnonzero((n == length) & (m == length))
                a, b = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist())).reshape(len(at), -1) for c in (x, y))
                out[at] = np.einsum("ij,ij->i", a, b)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out)], [*keep, "cosine"])

    return df.select(*keep, "x", "y").mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", cosine double")


def sketches_apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1"))) + F.bit_count(F.col(f"{a}2").bitwiseXOR(F.col(f"{b}2")))


def places_apart(a: str, b: str) -> Column:
    part = lambda c, k: F.shiftright(F.col(c), 8 * k).bitwiseAND(F.lit(255))
    return sum((F.abs(part(a, k) - part(b, k)) for k in range(SHARED)), F.lit(0))


def exploded(vectors: DataFrame, *columns) -> DataFrame:
    """(columns..., key, place): a row for each list that a vector is in."""
    rows = vectors.select(*columns, F.explode(F.arrays_zip("keys", "places")).alias("l"))
    return rows.select(*rows.columns[:-1], F.col("l.keys").alias("key"), F.col("l.places").alias("place"))


def balls_of(vectors: DataFrame, angle: float) -> DataFrame:
    """(digest, ball, radius): the centre's digest and the angle to it of each vector that belongs to another one's ball."""
    lists = exploded(vectors, "short", "s1", "s2").where(" and ".join(f"(shiftright(place, {8 * k}) & 255) < {FIRST}" for k in range(SHARED)))
    first = lists.groupBy("key").agg(F.min(F.struct("short", "s1", "s2")).alias("h"), F.count("*").alias("size")).where("size > 1")
    hubs = first.select("key", F.col("h.short").alias("hub"), F.col("h.s1").alias("t1"), F.col("h.s2").alias("t2"))
    near = lists.join(hubs, "key").where((F.col("short") != F.col("hub")) & (sketches_apart("s", "t") <= LIKE_HUB))
    chosen = near.groupBy("short").agg(F.min("hub").alias("hub"))
    member = chosen.join(vectors.select("short", "digest", F.col("unit").alias("x")), "short")
    both = member.join(vectors.select(F.col("short").alias("hub"), F.col("digest").alias("ball"), F.col("unit").alias("y")), "hub")
    close = with_cosine(both, ["digest", "ball"]).where(F.col("cosine") > math.cos(angle / 2) + 1e-9)
    return close.groupBy("digest").agg(F.min_by(F.struct("ball", "cosine"), "ball").alias("b")).select("digest", "b.ball", F.acos(F.least("b.cosine", F.lit(1.0))).alias("radius"))


def links_of(vectors: DataFrame, threshold: float, nearest: int) -> tuple[DataFrame, DataFrame]:
    """Of vectors (digest, short, rows, keys, places, s1, s2, unit): (digest, links) to rows of other classes, and edges (a, b) that connect all linked ones.

    Angles are compared with a margin, wherever a pair is near the threshold its own cosine decides.
    """
    angle, margin = math.acos(max(-1.0, min(1.0, threshold))), 1e-7
    joined = written(balls_of(vectors, angle))
    members = vectors.select("digest", "rows").join(joined, "digest", "left").select("digest", "rows", F.coalesce("ball", "digest").alias("ball"), F.coalesce("radius", F.lit(0.0)).alias("radius"))
    members = written(members)
    balls = members.groupBy("ball").agg(F.max("radius").alias("radius"), F.sum("rows").alias("weight"), F.count("*").alias("n"))
    centres = vectors.select(F.col("digest").alias("ball"), F.col("short").alias("centre"), "s1", "s2", "unit")
    balls = written(balls.join(centres, "ball").select("ball", "centre", "radius", "weight", "n", "s1", "s2", "unit"))
    # lists of balls: a ball once in a list; its members' places differ, so only lone vectors' places are compared
    named = members.select("digest", "ball").join(balls.select("ball", "centre", "n", F.col("radius").alias("r"), F.col("s1").alias("t1"), F.col("s2").alias("t2")), "ball")
    own = exploded(vectors.join(named, "digest"), "centre", "n", "r", F.col("t1").alias("s1"), F.col("t2").alias("s2"))
    many = own.where("n > 1").groupBy("key", "centre").agg(F.max("n").alias("n"), F.max("r").alias("r"), F.max("s1").alias("s1"), F.max("s2").alias("s2"), F.min("place").alias("place"))
    entry = written(own.where("n = 1").unionByName(many))
    spread = written(entry.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1"))
    if spread.count() <= BROADCAST_IDS:
        spread = F.broadcast(spread)
    cut = entry.join(spread, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = cut.withColumn("part", F.pmod(F.xxhash64("centre"), F.col("parts")).cast("int"))
    right = cut.select("key", *(F.col(c).alias(f"{c}_b") for c in ("centre", "n", "r", "place")), F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    reach = F.least(F.lit(math.pi), angle + F.col("r") + F.col("r_b"))
    lone = (F.col("n") == 1) & (F.col("n_b") == 1)
    met = left.join(right, ["key", "part"])
    met = met.where((F.col("centre") < F.col("centre_b")) & (sketches_apart("s", "t") <= largest_difference(reach)) & (~lone | (places_apart("place", "place_b") <= SHIFT * nearest)))
    pairs = met.groupBy("centre", "centre_b").agg(F.max(F.when(lone, 0).otherwise(1)).alias("many"))
    x = balls.select("centre", F.col("ball").alias("a"), F.col("radius").alias("ra"), F.col("weight").alias("wa"), F.col("n").alias("na"), F.col("unit").alias("x"))
    y = balls.select(F.col("centre").alias("centre_b"), F.col("ball").alias("b"), F.col("radius").alias("rb"), F.col("weight").alias("wb"), F.col("n").alias("nb"), F.col("unit").alias("y"))
    pairs = written(pairs)
    heavy = [written(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > BLOCK)) for c in ("centre", "centre_b")]
    judged = with_cosine(spread_join(spread_join(pairs, x, "centre", BLOCK, heavy[0], "centre_b"), y, "centre_b", BLOCK, heavy[1], "centre"), ["a", "b", "ra", "rb", "wa", "wb", "na", "nb"])
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine")))
    lone = (F.col("na") == 1) & (F.col("nb") == 1) & (F.col("ra") == 0) & (F.col("rb") == 0)
    whole = F.when(lone, F.col("cosine") >= threshold).otherwise(between + F.col("ra") + F.col("rb") <= angle - margin)
    none = F.when(lone, F.col("cosine") < threshold).otherwise(between - F.col("ra") - F.col("rb") > angle + margin)
    judged = written(judged.select("a", "b", "wa", "wb", "na", "nb", whole.alias("whole"), (~whole & ~none).alias("mixed")).where("whole or mixed"))
    # the rest: members against members, a ball's in blocks
    part = members.join(balls.select("ball", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "ball").select("ball", "digest", "rows", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"))
    mixed = judged.where("mixed").select("a", "b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("na") / BLOCK).cast("int") - 1)).alias("pa"), "nb").select("a", "b", "pa", F.explode(F.sequence(F.lit(0), F.ceil(F.col("nb") / BLOCK).cast("int") - 1)).alias("pb"))
    of = lambda s, d, r: part.select(F.col("ball").alias(s), F.col("part").alias(f"p{s}"), F.col("digest").alias(d), F.col("rows").alias(r))
    each = mixed.join(of("a", "p", "cp"), ["a", "pa"]).join(of("b", "q", "cq"), ["b", "pb"]).select("p", "q", "cp", "cq")
    unit_of = lambda d, v: vectors.select(F.col("digest").alias(d), F.col("unit").alias(v))
    exact = written(with_cosine(each.join(unit_of("p", "x"), "p").join(unit_of("q", "y"), "q"), ["p", "q", "cp", "cq"]).where(F.col("cosine") >= threshold).select("p", "q", "cp", "cq"))
    # rows of other classes: of the own ball, of balls that link as a whole, and of members paired
    whole = judged.where("whole")
    others = whole.select(F.col("a").alias("ball"), F.col("wb").alias("w")).unionByName(whole.select(F.col("b").alias("ball"), F.col("wa").alias("w"))).groupBy("ball").agg(F.sum("w").alias("w"))
    singles = exact.select(F.col("p").alias("digest"), F.col("cq").alias("w")).unionByName(exact.select(F.col("q").alias("digest"), F.col("cp").alias("w"))).groupBy("digest").agg(F.sum("w").alias("one"))
    counted = members.join(balls.select("ball", "weight"), "ball").join(others, "ball", "left").join(singles, "digest", "left")
    total = F.col("weight") - F.col("rows") + F.coalesce("w", F.lit(0)) + F.coalesce("one", F.lit(0))
    edges = members.where("digest <> ball").select(F.col("digest").alias("a"), F.col("ball").alias("b")).unionByName(whole.select("a", "b")).unionByName(exact.select(F.col("p").alias("a"), F.col("q").alias("b")))
    return counted.select("digest", total.alias("links")), edges


def embedding_near_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per row of df: id, n_links, component_id, kept."""
    plain = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"))
    sample = plain.where("id is not null and v is not null").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    most = pivot_count(plain.count() if len(sample) == SAMPLE else len(sample))
    pivots = choose_pivots([u for r in sample if (u := unit(r.v)) is not None], most)
    seen = written(describe(plain, pivots, nearest_of(most)))
    known = seen.where("digest is not null")
    short = priority(F.col("digest"))["h"].alias("short")
    columns = ("keys", "places", "s1", "s2", "unit")
    vectors = written(known.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in columns)).select("*", short))
    counts, edges = links_of(vectors, threshold, nearest_of(most))
    found = components(edges).withColumnRenamed("id", "digest")
    named = found.join(vectors.select("digest", "id"), "digest")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    linked = named.join(least, "component").select("digest", "least")
    of_class = counts.join(vectors.select("digest", "id", "rows"), "digest").join(linked, "digest", "left")
    of_class = of_class.select("digest", "rows", (F.col("rows") - 1 + F.col("links")).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    of_class = written(of_class)
    # the largest classes go to every executor, so no task gets all rows of one
    large = written(of_class.where(F.col("rows") > BLOCK).orderBy(F.desc("rows")).limit(BROADCAST_IDS))
    large = F.broadcast(large.select("digest", F.col("n_links").alias("n"), F.col("component_id").alias("c")))
    split = known.select("id", "digest").join(large, "digest", "left")
    out = split.where("n is null").select("id", "digest").join(of_class, "digest").select("id", "n_links", "component_id")
    out = out.unionByName(split.where("n is not null").select("id", F.col("n").alias("n_links"), F.col("c").alias("component_id")))
    out = out.unionByName(seen.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("component_id").isNull() | (F.col("component_id") == F.col("id"))).alias("kept"))
