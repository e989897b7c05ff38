"""Document fingerprints: rolling hashes of ten bytes, winnowing, sampling by modulo, and content-defined blocks.

Positions are exclusive end offsets (1 is after the first byte). Each document is worked on by itself in numpy arrays,
in one Arrow pass: its hashes are a closed form of ten terms, winnowing is a sliding minimum by block prefixes and
suffixes, linear in the document's length whatever the window. A plain SQL form of the same is the tests' oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5, sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.functions.arrow import in_small_batches, slices

# The polynomial's base and its number of terms.
BASE, TERMS = 77711, 10
MASK32 = (1 << 32) - 1
#: Bytes of texts whose rows are given at once.
SLICE = 1 << 20


def rolling_hashes(data: bytes) -> np.ndarray:
    """At index i the hash of the up to ten bytes that end at offset i + 1; bytes are signed."""
    b = np.frombuffer(data, dtype=np.int8).astype(np.int64)
    out = np.zeros(len(b), dtype=np.int64)
    for j in range(min(TERMS, len(b))):
        out[j:] += b[: len(b) - j] * (pow(BASE, j, 1 << 32))
    return out & MASK32


def sliding_minimum(x: np.ndarray, window: int) -> np.ndarray:
    """At index i the least of x[max(0, i - window + 1) : i + 1]."""
    top = np.iinfo(np.int64).max
    n = len(x) + window - 1
    padded = np.full(-(-n // window) * window, top, dtype=np.int64)
    padded[window - 1 : n] = x
    blocks = padded.reshape(-1, window)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: len(x)], before[window - 1 : n])


def winnow(data: bytes, average: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): the rightmost least hash of each window of 2 * average - 1 positions, once each."""
    window = 2 * average - 1
    last = len(data) - window - 1
    if last < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    positions = np.arange(1, last + 1, dtype=np.int64)
    both = (rolling_hashes(data)[:last] << 31) | ((1 << 31) - 1 - positions)
    chosen = np.unique(sliding_minimum(both, window))
    at = np.sort((1 << 31) - 1 - (chosen & ((1 << 31) - 1)))
    return at, rolling_hashes(data)[at - 1]


def sampled(data: bytes, average: int) -> tuple[np.ndarray, np.ndarray]:
    """(0-based indexes, hashes) where the hash is a multiple of average."""
    h = rolling_hashes(data)
    at = np.flatnonzero(h % average == 0)
    return at, h[at]


def two_way_minimum(data: bytes, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) where the hash is the least of the `reach` positions before and behind, the first of equal ones.

    So an edit moves only cuts that have changed bytes within their reach, and two cuts are further apart than `reach`.
    """
    h = rolling_hashes(data)
    if len(h) <= 2 * reach:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    both = (h << 31) | np.arange(len(h))
    middle = both[reach : len(h) - reach]
    at = np.flatnonzero(sliding_minimum(both, 2 * reach + 1)[2 * reach :] == middle) + reach
    return at + 1, h[at]


def block_hash(block: bytes) -> int:
    """A 60-bit hash that SQL can compute: of the block's hex digits."""
    return int(md5(block.hex().upper().encode()).hexdigest()[:15], 16)


def blocks(data: bytes, average: int, overlap: int = 0, cuts: Callable[[bytes, int], tuple[np.ndarray, np.ndarray]] = winnow) -> list[tuple[int, int, int]]:
    """(start, length, hash): cut at the fingerprints, or where `cuts` says; a block is hashed with `overlap` bytes of the next one."""
    ends = [*cuts(data, average)[0].tolist(), len(data)]
    starts = [0, *ends[:-1]]
    return [(s, e - s, block_hash(data[s : e + overlap] if e < len(data) else data[s:e])) for s, e in zip(starts, ends, strict=True) if e > s]


def per_document(df: DataFrame, columns: list[str], one: Callable[[bytes], list]) -> DataFrame:
    """df (doc_id, text) -> doc_id and long columns: the rows that `one` makes of a text's bytes."""

    def work(batches):
        for batch, texts in slices(batches, "text", SLICE):
            lengths, parts = [], [[] for _ in columns]
            for text in texts:
                found = one(text)
                lengths.append(len(found[0]) if found else 0)
                for part, c in zip(parts, found, strict=bool(found)):
                    part.append(np.asarray(c, dtype=np.int64))
            docs = np.repeat(batch.column(0).to_numpy(), lengths)
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(docs), *(pa.array(np.concatenate(p)) for p in parts)], ["doc_id", *columns])

    rows = in_small_batches(df).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "utf-8").alias("text"))
    return rows.mapInArrow(work, ", ".join(f"{c} long" for c in ["doc_id", *columns]))


def fingerprints(df: DataFrame, average: int) -> DataFrame:
    return per_document(df, ["pos", "h"], lambda data: list(winnow(data, average)))


def samples(df: DataFrame, average: int) -> DataFrame:
    return per_document(df, ["pos", "h"], lambda data: list(sampled(data, average)))


def digests(df: DataFrame, average: int, overlap: int = 0, cuts: Callable[[bytes, int], tuple[np.ndarray, np.ndarray]] = winnow) -> DataFrame:
    """(doc_id, block_no, start, len, h)."""

    def one(data: bytes) -> list:
        found = blocks(data, average, overlap, cuts)
        return [range(len(found)), *zip(*found, strict=True)] if found else []

    return per_document(df, ["block_no", "start", "len", "h"], one)


def hash_summary(df: DataFrame) -> DataFrame:
    """(doc_id, n, hash_sum, hash_xor, hash_min, hash_max) of all rolling hashes."""

    def one(data: bytes) -> list:
        h = rolling_hashes(data)
        return [[len(h)], [h.sum()], [np.bitwise_xor.reduce(h)], [h.min()], [h.max()]] if len(h) else []

    return per_document(df, ["n", "hash_sum", "hash_xor", "hash_min", "hash_max"], one)


def hash_sets(hashes: DataFrame) -> DataFrame:
    """(doc_id, hs): each document's distinct hashes of (doc_id, h), sorted."""
    return hashes.groupBy("doc_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))


def document_sets(df: DataFrame, one: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(doc_id, hs): each document's distinct hashes, of df (doc_id, text), made in the pass that has the text in hand."""

    def work(batches):
        for batch, texts in slices(batches, "text", SLICE):
            sets = [np.unique(one(text)) for text in texts]
            offsets = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).astype(np.int64)))], ["doc_id", "hs"])

    rows = in_small_batches(df).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "utf-8").alias("text"))
    # rows of one id are one document
    return rows.mapInArrow(work, "doc_id long, hs array<long>").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs"))


def fingerprint_sets(df: DataFrame, average: int) -> DataFrame:
    return document_sets(df, lambda data: winnow(data, average)[1])


def digest_sets(df: DataFrame, average: int, overlap: int = 0) -> DataFrame:
    return document_sets(df, lambda data: np.array([h for _, _, h in blocks(data, average, overlap)], dtype=np.int64))


def jaccard(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(d1, d2, inter, uni) of each pair's distinct hashes, given as (doc_id, h) or as sets (doc_id, hs). Sets are joined whole, a document's
    in one row, so a task's memory follows its sets' sorting and no hash is shuffled once for each pair's side."""
    sets = hashes if "hs" in hashes.columns else hash_sets(hashes)
    side = lambda k: sets.select(F.col("doc_id").alias(f"d{k}"), F.col("hs").alias(f"h{k}"))
    both = pairs.select("d1", "d2").distinct().join(side(1), "d1", "left").join(side(2), "d2", "left")
    size = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    h1, h2 = F.col("h1"), F.col("h2")
    sized = both.select("d1", "d2", size(F.array_intersect(h1, h2)).alias("inter"), (size(h1) + size(h2)).alias("both"))
    return sized.select("d1", "d2", "inter", (F.col("both") - F.col("inter")).alias("uni")).where("uni > 0")


def named_blocks(df: DataFrame, average: int, overlap: int = 0) -> DataFrame:
    """(h, block): each block's hash and the SHA-1 of its bytes, made in the pass that has the text in hand."""

    def work(batches):
        for _, texts in slices(batches, "text", SLICE):
            found = [(h, sha1(data[s : s + n]).digest()) for data in texts for s, n, h in blocks(data, average, overlap)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["h", "block"])

    return in_small_batches(df).where("doc_id is not null").select("text").mapInArrow(work, "h long, block binary")


def collisions(df: DataFrame, average: int) -> DataFrame:
    """(h, n): block hashes of df (doc_id, text) that stand for n > 1 different blocks."""
    return named_blocks(df, average).groupBy("h").agg(F.countDistinct("block").alias("n")).where("n > 1")
