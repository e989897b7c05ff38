"""File synchronisation between two versions of many files at once, and plans for directories.

A file's blocks are cut at its content's fingerprints, so an edit changes the blocks around it only. The receiver of a
plan has the old version; blocks it has are referred to, the others are sent. Blocks are identified by hash and length.
"""

from __future__ import annotations

import zlib
from hashlib import sha1

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symdiff.operators import fingerprint
from symdiff.operators.sets import chance

# Fixed value: the least average block.
LEAST_BLOCK = 700


def block_size(length: Column) -> Column:
    return F.greatest(F.lit(LEAST_BLOCK), F.floor(F.sqrt(length))).cast("long")


def overlap_of(length: Column, block: Column) -> Column:
    """Bytes of the next block that a hash covers: enough to tell the blocks of the file apart, at least one."""
    return F.greatest(F.lit(1), F.floor(F.log(F.greatest(F.floor(length / block), F.lit(1)).cast("double")) / F.log(F.lit(256.0))) + 1).cast("int")


def sync_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, block_no, start, len, exists, local, ref): what is sent for each block of the new version.

    ref is the block's rank among the old version's distinct blocks by hash, or, if the block before it exists as well
    (local), its rank among the shared ones; null for a block that is sent itself. Blocks of both versions, (doc_id, block_no,
    start, len, h), are shuffled by document once, together; all else are windows over a document's blocks in that order.
    """
    absent = F.lit(None).cast("long")
    mine = old.select("doc_id", "h", "len", absent.alias("block_no"), absent.alias("start"), F.lit(0).alias("side"))
    both = mine.unionByName(new.select("doc_id", "h", "len", "block_no", "start", F.lit(1).alias("side"))).repartition("doc_id")
    same = Window.partitionBy("doc_id", "h", "len").orderBy("side")
    exists = F.first("side").over(same) == 0
    # the first of equal blocks of the old version, and the first one of the new version behind them
    first = both.select("*", exists.alias("exists"), (F.row_number().over(same) == 1).alias("is_first"), F.lag("side").over(same).alias("last"))
    marked = first.select("doc_id", "h", "len", "block_no", "start", "side", "exists", (F.col("is_first") & (F.col("side") == 0)).alias("own"), ((F.col("side") == 1) & (F.coalesce("last", F.lit(1)) == 0)).alias("shared"))
    up_to = Window.partitionBy("doc_id").orderBy("h", "len")
    ranks = [(F.sum(F.col(c).cast("long")).over(up_to) - 1).alias(n) for c, n in (("own", "rank"), ("shared", "near"))]
    plan = marked.select("doc_id", "block_no", "start", "len", "side", "exists", *ranks).where("side = 1")
    before = F.coalesce(F.lag("exists").over(Window.partitionBy("doc_id").orderBy("block_no")), F.lit(False))
    out = plan.withColumn("local", F.col("exists") & before)
    return out.select("doc_id", "block_no", "start", "len", "exists", "local", F.when(F.col("local"), F.col("near")).when(F.col("exists"), F.col("rank")).alias("ref"))


def reconstructed(old: DataFrame, new: DataFrame, average: int, overlap: int = 1) -> DataFrame:
    """(doc_id, sha1) of the new version, put together from blocks of the old one and literal blocks.

    old, new: (doc_id, text). Both texts of a document meet in one row, once.
    """
    both = new.select("doc_id", F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("theirs")).where("octet_length(theirs) > 0")
    both = both.join(old.select("doc_id", F.encode("text", "utf-8").alias("mine")), "doc_id", "left")

    def work(batches):
        for batch in batches:
            hashes = []
            for theirs, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                known: dict[tuple[int, int], int] = {}
                for start, length, h in fingerprint.blocks(mine or b"", average, overlap):
                    known.setdefault((h, length), start)
                parts = []
                for start, length, h in fingerprint.blocks(theirs, average, overlap):
                    at = known.get((h, length))
                    parts.append(theirs[start : start + length] if at is None else mine[at : at + length])
                hashes.append(sha1(b"".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string())], ["doc_id", "sha1"])

    return both.select(F.col("doc_id").cast("long").alias("doc_id"), "theirs", "mine").mapInArrow(work, "doc_id long, sha1 string")


@F.pandas_udf(T.BinaryType())
def compressed(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.compress(x, 9))


@F.pandas_udf(T.BinaryType())
def decompressed(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.decompress(x))


def sync_bytes(plan: DataFrame, ref_bits: int = 16) -> DataFrame:
    """(doc_id, literal_bytes, reference_bits, plan_bytes): what the plan costs."""
    costs = plan.groupBy("doc_id").agg(
        F.sum(F.when(~F.col("exists"), F.col("len")).otherwise(0)).alias("literal_bytes"), (F.count_if("exists") * ref_bits + F.count("*") * 2).alias("reference_bits")
    )
    return costs.withColumn("plan_bytes", (F.col("literal_bytes") + F.ceil(F.col("reference_bits") / 8)).cast("long"))


# Corruption models


# Odd multipliers and shifts of the hash that draws positions.
DRAW = (2654435761, 2246822519, 3266489917), (15, 739982445), (12, 695872825), 15


def drawn(doc_id: int, n: int, probability: float, seed: int) -> np.ndarray:
    """The positions of a file of n bytes that change: where a 32-bit hash of file, position and seed is small enough."""
    (a, b, c), first, second, last = DRAW
    x = (np.arange(n, dtype=np.uint64) * np.uint64(a) + np.uint64((doc_id * b + seed * c) & 0xFFFFFFFF)) & np.uint64(0xFFFFFFFF)
    for shift, times in (first, second):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(times)) & np.uint64(0xFFFFFFFF)
    return np.flatnonzero((x ^ (x >> np.uint64(last))) < int(probability * (1 << 32)))


def similar_files(files: DataFrame, probability: float, seed: int = 0) -> DataFrame:
    """(doc_id, n_changed, content) of files (doc_id, text): each byte goes one up with the probability."""

    def work(batches):
        for batch in batches:
            counts, contents = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text, dtype=np.uint8).copy()
                at = drawn(doc_id, len(data), probability, seed)
                data[at] += np.uint8(1)
                counts.append(len(at))
                contents.append(data.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(contents, pa.binary())], ["doc_id", "n_changed", "content"])

    rows = files.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("data"))
    return rows.mapInArrow(work, "doc_id long, n_changed long, content binary")


def corrupted_blocks(lengths: DataFrame, changes: int, size: int, seed: int = 0, *others: str) -> DataFrame:
    """(doc_id, starts): starts of changed blocks of `size` bytes; a start inside a block that is being changed is skipped."""
    room = F.greatest(F.col("n") - size, F.lit(1).cast("long"))
    drawn = F.array(*(F.floor(chance(seed + k, F.col("doc_id")) * room).cast("long") for k in range(changes)))
    keep = lambda a, s: F.when((F.size(a) == 0) | (s >= F.element_at(a, -1) + size), F.concat(a, F.array(s))).otherwise(a)
    first = F.slice(F.array_sort(F.array_distinct(drawn)), 1, 1)
    starts = F.aggregate(F.slice(F.array_sort(F.array_distinct(drawn)), 2, changes), first, keep)
    return lengths.where(F.col("n") > 0).select("doc_id", *others, starts.alias("starts"))


def block_changed_files(files: DataFrame, changes: int, size: int, seed: int = 0) -> DataFrame:
    """(doc_id, n_blocks, content) of files (doc_id, text): each byte of the changed blocks goes one up."""
    rows = files.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("data"))
    starts = corrupted_blocks(rows.select("doc_id", F.octet_length("data").cast("long").alias("n"), "data"), changes, size, seed, "data")

    def work(batches):
        for batch in batches:
            contents = []
            for where, raw in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(raw, dtype=np.uint8).copy()
                for s in where:
                    data[s : s + size] += np.uint8(1)
                contents.append(data.tobytes())
            counts = [len(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(contents, pa.binary())], ["doc_id", "n_blocks", "content"])

    return starts.select("doc_id", "data", "starts").mapInArrow(work, "doc_id long, n_blocks long, content binary")


# Directories


def manifest(files: DataFrame) -> DataFrame:
    """(path, name_sha1, content_sha1) of files (path, content BINARY); names that start with a dot are left out."""
    return files.where(~F.col("path").startswith(".")).select("path", F.sha1(F.encode("path", "utf-8")).alias("name_sha1"), F.sha1("content").alias("content_sha1"))


def manifest_keys(listed: DataFrame) -> DataFrame:
    """(path, key): a file's name and content hashes in 40 bytes."""
    return listed.select("path", F.concat(F.unhex("name_sha1"), F.unhex("content_sha1")).alias("key"))


def name_and_content(key: Column) -> tuple[Column, Column]:
    return F.substring(key, 1, 20), F.substring(key, 21, 20)


def directory_cells(estimate: int) -> tuple[int, int]:
    """(cells, hashes) of the table for a directory's differences."""
    return 2 * estimate, 3 if estimate < 200 else 4


def directory_plan(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, action, target): what the other side has to do to become like mine.

    modified: same path, other content; rename: its content is mine under another path (target: the least one); delete:
    neither; new: a path of mine that it lacks and whose content no rename provides.
    """
    a = mine.select("path", F.col("content_sha1").alias("a"))
    b = theirs.select("path", F.col("content_sha1").alias("b"))
    both = a.join(b, "path", "full")
    homes = mine.groupBy("content_sha1").agg(F.min("path").alias("target")).withColumnRenamed("content_sha1", "b")
    gone = both.where("a is null").join(homes, "b", "left")
    old = gone.select("path", F.when(F.col("target").isNotNull(), "rename").otherwise("delete").alias("action"), "target")
    changed = both.where("a is not null and b is not null and a <> b").select("path", F.lit("modified").alias("action"), F.lit(None).cast("string").alias("target"))
    given = old.where("action = 'rename'").select(F.col("target").alias("path")).distinct()
    new = both.where("b is null").join(given, "path", "left_anti").select("path", F.lit("new").alias("action"), F.lit(None).cast("string").alias("target"))
    return old.unionByName(changed).unionByName(new)
