"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. Each document's distinct word shingles are hashed once; the range of hashes is cut into BINS, a bin's signature is its
   least hash, an empty bin borrows from a filled one that a fixed random sequence of bins finds (optimal densification).
2. Documents with the same shingle set are one class, which its digest stands for; ids come back at the end only.
3. Signatures are cut into bands. In each bucket (documents that agree on a band) every member is paired with the
   bucket's hub only, a star: as many pairs as members, however large the bucket.
4. Pairs are confirmed on the full shingle sets, which are made again for documents in shared buckets only.
5. Confirmed pairs give components. Buckets that hold several components get HUBS further stars at once, between hubs of
   the bucket's own and the members of other components. Hubs have then been compared with all they aren't linked with,
   and leave their bucket; a bucket whose rest is one component is settled.
6. What is still in mixed buckets is joined exactly by its rare shingles: of two sets that reach the threshold, the least
   of their shared shingles in any one order lies among the first few of both (prefix filter).
   The order starts with rare shingles, so that what a family of documents has in common comes last.

Defined results: ASCII letters are lower-cased, words are runs of anything but ASCII white space; a document of fewer
words than a shingle has its whole sequence as one; without words or text it has none, is linked with nothing and is
kept; a row with a null id is linked with nothing, its component is null and it is kept; repeated rows are each judged
by their own text, rows of one id with different texts too, whatever their order; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symdiff.llm.common import Memory, in_small_batches, releasing, slices, spread_join, written
from symdiff.llm.components import components, extended, priority

BINS = 240
#: Chance that a pair just at the threshold shares no band.
MISS = 1e-8
#: Ids up to this many are sent to every executor instead of shuffling the texts (8 bytes each), and classes of many rows (24).
BROADCAST_IDS = 500_000
#: Stars after the first in buckets that still hold several components; the exact join settles the rest.
HUBS = 4
#: Counters of shingles, by their lower bits. They only order shingles: a shared counter makes a join larger, not wrong.
PLACES = 1 << 18
#: Documents of a rare shingle or members of a bucket that a join deals to one task; classes of more rows are large ones.
BLOCK = 512
#: Words whose hashes a task remembers, and bytes of text whose shingles are made at once.
CACHE = 1 << 16
SLICE = 1 << 20
LOW48 = np.uint64((1 << 48) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def band_rows(percent: int) -> int:
    """Rows of a band: as many as keep the chance of a miss at the threshold under MISS."""
    s = percent / 100
    return max([1, *(r for r in range(1, 13) if (1 - s**r) ** (BINS // r) <= MISS)])


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int):
        self.words, self.known = words, Memory(CACHE)
        self.factors = stream(words, 7) | np.uint64(1)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.lower().split() for t in texts]
        missing = self.known.missing(set().union(*split))
        self.known.new.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
        get, k, out = self.known.new.__getitem__, self.words, []
        flat = np.fromiter((get(w) for ws in split for w in ws), dtype=np.uint64, count=sum(map(len, split)))
        whole = np.zeros(max(0, len(flat) - k + 1), dtype=np.uint64)
        for j in range(k):
            whole += flat[j : len(flat) - k + 1 + j] * self.factors[j]
        whole, at = mixed(whole), 0
        for ws in split:
            n = len(ws)
            if n >= k:
                out.append(np.unique(whole[at : at + n - k + 1]))
            elif n:
                out.append(mixed((flat[at : at + n] * self.factors[:n]).sum(keepdims=True) + np.uint64(n)))
            else:
                out.append(flat[:0])
            at += n
        return out


class Bands:
    def __init__(self, percent: int):
        self.rows = band_rows(percent)
        self.count = BINS // self.rows
        self.probe = (stream(BINS * 512, 11) % np.uint64(BINS)).astype(np.int64).reshape(512, BINS)
        self.factors = stream(self.rows, 13) | np.uint64(1)
        self.salt = stream(self.count, 17)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Least hash of each bin; hashes are sorted, so a bin's least is its first."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(bins, prepend=np.uint64(1 << 63)))
        filled = np.zeros(BINS, dtype=bool)
        out = np.zeros(BINS, dtype=np.uint64)
        at = bins[first].astype(np.int64)
        out[at], filled[at] = hashes[first], True
        empty = np.flatnonzero(~filled)
        for tried in range(1 << 20):
            if not len(empty):
                break
            # beyond the table, the sequence goes on with shifted probes
            probe = (self.probe[tried % 512][empty] + tried // 512) % BINS
            found = filled[probe]
            out[empty[found]] = out[probe[found]]
            empty = empty[~found]
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        s = self.signature(hashes)[: self.rows * self.count].reshape(self.count, self.rows)
        return mixed((s * self.factors).sum(axis=1, dtype=np.uint64) ^ self.salt).view(np.int64)


def digest_of(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def features(df: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, digest, bands); digest and bands are null for documents without shingles or id."""

    def work(batches):
        shingler, bands = Shingler(words), Bands(percent)
        for batch, texts in slices(batches, "text", SLICE):
            ids, sets = batch.column(0), shingler.sets(texts)
            used = [len(h) > 0 and i is not None for h, i in zip(sets, ids.to_pylist(), strict=True)]
            digests = [digest_of(h) if u else None for h, u in zip(sets, used, strict=True)]
            keys = [bands.keys(h) if u else None for h, u in zip(sets, used, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(h) for h in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n", "digest", "bands"],
            )

    return df.mapInArrow(releasing(work), "id long, n long, digest binary, bands array<long>")


def shingle_sets(df: DataFrame, words: int) -> DataFrame:
    """(id, n, hashes) of texts, id being the digest: the sets as sorted 48-bit hashes in 64-bit cells without the upper two bytes."""

    def work(batches):
        shingler = Shingler(words)
        for batch, texts in slices(batches, "text", SLICE):
            sets = [h for h in shingler.sets(texts) if len(h)]
            packed = [np.unique(h & LOW48).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(h) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64()), pa.array(packed, pa.binary())], ["id", "n", "hashes"])

    return df.select("text").mapInArrow(releasing(work), "id binary, n long, hashes binary")


def unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union; a is the hub, whose set is joined last, and goes to as many
    tasks as its pairs fill blocks."""

    def work(batches):
        for batch in batches:
            a, b, n, m, x, y = (batch.column(k).to_pylist() for k in range(6))
            keep, hub, own = [], None, None
            for i in range(len(a)):
                if 100 * min(n[i], m[i]) < percent * max(n[i], m[i]):
                    continue
                if a[i] != hub:
                    hub, own = a[i], unpacked(x[i])
                shared = np.concatenate((own, unpacked(y[i])))
                shared.sort(kind="stable")
                both = int((shared[1:] == shared[:-1]).sum())
                if 100 * both >= percent * (n[i] + m[i] - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary())], ["a", "b"])

    right = sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("hashes").alias("y"))
    left = sets.select(F.col("id").alias("a"), "n", F.col("hashes").alias("x"))
    pairs = written(pairs)
    heavy = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > BLOCK))
    near = spread_join(pairs.join(right, "b"), left, "a", BLOCK, heavy, "b")
    return near.select("a", "b", "n", "m", "x", "y").mapInArrow(releasing(work), "a binary, b binary")


def rarity(sets: DataFrame) -> np.ndarray:
    """Of each place: how many shingles of sets (hashes) fall into it."""

    def work(batches):
        counts = np.zeros(PLACES, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                np.add.at(counts, (unpacked(packed) % np.uint64(PLACES)).astype(np.int64), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["place", "k"])

    found = sets.select("hashes").mapInArrow(releasing(work), "place int, k long").groupBy("place").agg(F.sum("k").alias("k")).toArrow()
    out = np.zeros(PLACES, dtype=np.int64)
    out[found.column("place").to_numpy()] = found.column("k").to_numpy()
    return out


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, id, c, n, at, inner) of the first shingles of sets (id, c, hashes), rare ones first.

    Let x be the larger of two sets that reach the threshold t, y the smaller. They share at least t|x| and 2t/(1+t)|y|
    shingles, so the first shared one is among the first |x| - t|x| + 1 of x and |y| - 2t/(1+t)|y| + 1 of y (inner).
    """
    counts = rarity(sets)

    def work(batches):
        for batch in batches:
            own, columns = [], [[] for _ in range(4)]
            for k, p in enumerate(batch.column(2).to_pylist()):
                h = unpacked(p)
                n = len(h)
                first = n + (-percent * n) // 100 + 1
                inner = n + (-2 * percent * n) // (100 + percent) + 1
                order = np.lexsort((h, counts[(h % np.uint64(PLACES)).astype(np.int64)]))[:first]
                at = np.arange(len(order))
                own.append(np.full(len(order), k))
                for column, x in zip(columns, (h[order].view(np.int64), np.full(len(order), n), at, at < inner), strict=True):
                    column.append(x)
            if own:
                shingle, n, at, inner = (pa.array(np.concatenate(x)) for x in columns)
                own = pa.array(np.concatenate(own))
                yield pa.RecordBatch.from_arrays([shingle, batch.column(0).take(own), batch.column(1).take(own), n, at, inner], ["shingle", "id", "c", "n", "at", "inner"])

    return sets.select("id", "c", "hashes").mapInArrow(releasing(work), "shingle long, id binary, c binary, n long, at long, inner boolean")


def candidates(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components in rest (id, c) that may reach the threshold."""
    rows = written(prefixes(sets.join(rest, "id").select("id", "c", "hashes"), percent))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("inner").alias("some")).where("low <> high and some")
    rows = written(rows.join(shared.select("shingle", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "shingle"))
    x = rows.select("shingle", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), *(F.col(k).alias(f"x_{k}") for k in ("id", "c", "n", "at")))
    y = rows.where("inner").select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(k).alias(f"y_{k}") for k in ("id", "c", "n", "at")))
    near = y.join(x, ["shingle", "part"]).where(
        f"y_c <> x_c and (y_n < x_n or (y_n = x_n and y_id < x_id)) and 100 * y_n >= {percent} * x_n"
        f" and {100 + percent} * least(x_n - x_at, y_n - y_at) >= {percent} * (x_n + y_n)"
    )
    return near.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def in_mixed_buckets(named: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """The rows of named (key, parts, id, c) in buckets that hold several components, each with its bucket's row of hubs (key, hubs)."""
    keys = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("parts").alias("most")).where("low <> high").drop("low", "high")
    keys = (keys.join(hubs, "key") if hubs else keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("most") - 1))).drop("most")
    return named.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(keys, ["key", "part"]).drop("part")


def near_components(df: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of df (id, text): its features; (digest, id, rows) of the classes, id being the smallest; and (digest, component) of
    those that are linked with another class, component being the smallest id of them all."""
    seen = written(features(df, words, percent))
    # equal digests have equal bands; copies are brought together before they are shuffled
    classes = written(seen.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.first("bands").alias("bands")))
    # buckets are found by a short hash of the digest, the one that orders stars; equal ones only make buckets larger
    short = priority(F.col("digest"))["h"].alias("short")
    names = classes.select(short, F.col("digest").alias("id"))
    rows = classes.select(short, F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("short").alias("first")).where("size > 1")
    hubs = hubs.join(names.groupBy(F.col("short").alias("first")).agg(F.min("id").alias("hub")), "first")
    buckets = rows.join(hubs.select("key", "hub", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "key")
    buckets = written(buckets.join(names, "short").select("key", "id", "hub", "parts"))
    ids = written(buckets.select(F.col("id").alias("digest")).distinct().join(classes, "digest").select("id").distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = written(shingle_sets(df.join(ids, "id", "left_semi"), words).dropDuplicates(["id"]))
    pairs = buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    found = components(confirmed(pairs, sets, percent))
    named = buckets.where("id <> hub").select("key", "parts", "id").join(found, "id", "left").select("key", "parts", "id", F.coalesce("component", "id").alias("c"))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("id", "key"), "id"))
    hubs = named.withColumn("at", first).where(F.col("at") <= HUBS).groupBy("key").agg(F.collect_list(F.struct("id", "c")).alias("hubs"))
    left = written(in_mixed_buckets(named, hubs))
    if not left.isEmpty():
        own = F.array_contains("hubs.id", F.col("id"))
        pairs = left.select("id", "c", own.alias("own"), F.explode("hubs").alias("h")).where("c <> h.c and not (own and id > h.id)")
        more = written(confirmed(pairs.select(F.col("h.id").alias("a"), F.col("id").alias("b")).distinct(), sets, percent))
        if not more.isEmpty():
            found = extended(found, more)
        named = left.where(~own).select("key", "parts", "id").join(found, "id", "left").select("key", "parts", "id", F.coalesce("component", "id").alias("c"))
        rest = written(in_mixed_buckets(named).select("id", "c").distinct())
        if not rest.isEmpty():
            more = written(confirmed(candidates(rest, sets, percent), sets, percent))
            if not more.isEmpty():
                found = extended(found, more)
    classes = classes.select("digest", "id", "rows")
    named = found.select(F.col("id").alias("digest"), F.col("component").alias("c")).join(classes, "digest").select("digest", "c", "id")
    least = named.groupBy("c").agg(F.min("id").alias("component"))
    return seen.select("id", "n", "digest"), classes, written(named.join(least, "c").select("digest", "component"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, kept."""
    plain = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    seen, classes, linked = near_components(plain, words, percent)
    found = classes.join(linked, "digest", "left").where("rows > 1 or component is not null").select("digest", "rows", F.coalesce("component", "id").alias("component_id"))
    found = written(found)
    # the largest classes go to every executor, so no task gets all rows of one; smaller ones are joined
    large = F.broadcast(written(found.where(F.col("rows") > BLOCK).orderBy(F.desc("rows")).limit(BROADCAST_IDS).select("digest", F.col("component_id").alias("large_id"))))
    at_once = seen.where("digest is not null").join(large, "digest", "left")
    joined = at_once.where("large_id is null").select("id", "n", "digest").join(found.select("digest", "component_id"), "digest", "left")
    out = joined.select("id", "n", "component_id").unionByName(at_once.where("large_id is not null").select("id", "n", F.col("large_id").alias("component_id")))
    out = out.unionByName(seen.where("digest is null").select("id", "n", F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (component.isNull() | (component == F.col("id"))).alias("kept"))
