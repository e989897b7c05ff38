"""The two-round synchronisation of many files at once, from what the sender (new version) and the receiver (old one) tell each other.

1. Both cut their version into blocks, with the block size and overlap of the longer one, and name blocks by a key.
2. Strata estimators of the keys give each file's number of different keys, that the size of its lookup table; the
   tables' difference is decoded. Files whose table fails get one of twice the cells.
3. The sender then knows the receiver's keys: its own without those that only it has, with those that only the receiver has.
   Round 2 says of each of its blocks whether the receiver has it, where in an order that both know, or its bytes.
4. The receiver replays round 2 over its own version and compares the hash of the whole.

A file's two versions meet in one row. The sketches of a lot of files (LOT_FILES, LOT_BYTES) are filled, subtracted and
peeled together in whole columns, in the pass that has their texts in hand; nothing is shuffled for them. Null and missing versions are empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import md5, sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdiff.functions.arrow import in_small_batches, release
from symdiff.functions.hashing import SEEDS, murmur64a_numpy
from symdiff.operators import codec, fingerprint, iblt, strata
from symdiff.operators.filesync import block_size, compressed, overlap_of

# Cells of a table for each key that is thought to differ, and its number of hashes.
CELLS_PER_KEY, HASHES = 2, 4
#: Small differences need more cells than that.
LEAST_CELLS = 80

Block = tuple[int, int, int, bytes, bytes]  # start, length, key, first bytes, bytes that follow


def agreed(files: DataFrame, average: int | None = None, overlap: int | None = None) -> DataFrame:
    """files (doc_id, old BINARY, new BINARY) with the block size and the overlap that both sides take."""
    n = F.greatest(F.octet_length("old"), F.octet_length("new"))
    block = block_size(n) if average is None else F.lit(average).cast("long")
    rows = files.select("doc_id", "old", "new", block.alias("block"), n.alias("n"))
    bytes_ = overlap_of(F.col("n"), F.col("block")) if overlap is None else F.lit(overlap)
    return rows.select("doc_id", "old", "new", "block", bytes_.alias("overlap"))


def paired(old: DataFrame, new: DataFrame, average: int | None = None, overlap: int | None = None) -> DataFrame:
    """(doc_id, old, new, block, overlap) of the files of new (doc_id, text)."""
    left = in_small_batches(new).where("doc_id is not null").select("doc_id", F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("new"))
    both = left.join(old.select("doc_id", F.encode("text", "utf-8").alias("old")), "doc_id", "left").withColumn("old", F.coalesce("old", F.lit(b"")))
    return agreed(both, average, overlap)


def block_key(covered: bytes, length: int) -> int:
    """60 bits of a hash of the bytes that a block covers and its length, which SQL can compute."""
    return int(md5(f"{covered.hex().upper()}:{length}".encode()).hexdigest()[:15], 16)


def blocks(data: bytes, average: int, overlap: int) -> list[Block]:
    ends = [*fingerprint.winnow(data, average)[0].tolist(), len(data)]
    out = []
    for s, e in zip([0, *ends[:-1]], ends, strict=True):
        if e > s:
            covered = data[s : e + overlap]
            out.append((s, e - s, block_key(covered, e - s), covered[:overlap], covered[e - s :]))
    return out


def first_of_each(found: list[Block]) -> dict[int, Block]:
    """Each key's first block, by rising key."""
    first: dict[int, Block] = {}
    for b in found:
        first.setdefault(b[2], b)
    return dict(sorted(first.items()))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def signed_keys(files: DataFrame) -> DataFrame:
    """(doc_id, key, sign): the distinct keys of each file's versions, 1 for the new one and -1 for the old one."""

    def work(batches):
        for r in rows_of(batches):
            for sign, data in ((1, r["new"]), (-1, r["old"])):
                keys = list(first_of_each(blocks(data, r["block"], r["overlap"])))
                columns = [r["doc_id"]] * len(keys), keys, [sign] * len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "key", "sign"])

    return files.mapInArrow(work, "doc_id long, key long, sign long")


class Tables:
    """Many small lookup tables side by side, which are filled, subtracted and peeled together."""

    def __init__(self, per_sub: np.ndarray):
        self.per_sub = per_sub.astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.per_sub * HASHES)])
        self.keys, self.checks, self.counts = (np.zeros(self.base[-1], dtype=t) for t in (np.uint64, np.uint64, np.int64))

    def add(self, table: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> Tables:
        checks, per_sub = murmur64a_numpy(keys, SEEDS[0]), self.per_sub[table]
        for i in range(HASHES):
            at = self.base[table] + i * per_sub + (murmur64a_numpy(keys, SEEDS[i + 1]) % per_sub.astype(np.uint64)).astype(np.int64)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)
            np.add.at(self.counts, at, signs)
        return self

    def filled(self) -> np.ndarray:
        return (self.keys != 0) | (self.checks != 0) | (self.counts != 0)

    def packed(self, some: list[int]) -> list[bytes]:
        """Each table as octets."""
        at, out = np.flatnonzero(self.filled()), []
        for t in some:
            own = at[slice(*np.searchsorted(at, self.base[t : t + 2]))]
            out.append(codec.pack_cells(own - self.base[t], self.keys[own], self.checks[own], self.counts[own]))
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tables, keys, signs) of what they hold, and of each table whether nothing is left."""
        found: set[tuple[int, int]] = set()
        parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
        while True:
            hit = np.flatnonzero(np.abs(self.counts) == 1)
            hit = hit[murmur64a_numpy(self.keys[hit], SEEDS[0]) == self.checks[hit]]
            table, keys, signs = np.searchsorted(self.base, hit, "right") - 1, self.keys[hit], self.counts[hit]
            order = np.lexsort((keys, table))
            table, keys, signs = table[order], keys[order], signs[order]
            first = np.concatenate([[True], (np.diff(table) != 0) | (keys[1:] != keys[:-1])])[: len(keys)]
            fresh = np.array([x not in found for x in zip(table[first].tolist(), keys[first].tolist(), strict=True)], dtype=bool)
            new = table[first][fresh], keys[first][fresh], signs[first][fresh]
            if not len(new[0]):  # also ends the rounds if a false checksum match came back
                break
            found.update(zip(new[0].tolist(), new[1].tolist(), strict=True))
            parts.append(new)
            self.add(new[0], new[1], -new[2])
        left = np.add.reduceat(np.append(self.filled(), False), self.base[:-1]) if len(self.per_sub) else np.zeros(0)
        return *(np.concatenate(x) for x in zip(*parts, strict=True)), left == 0


def strata_of(file: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table, key): the estimators' tables of keys, 64 a file, and what goes into them."""
    hashed = murmur64a_numpy(keys, 0)
    low = hashed & (~hashed + np.uint64(1))
    level = np.where(hashed == 0, strata.STRATA - 1, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64))
    return file * strata.STRATA + np.minimum(level, strata.STRATA - 1), hashed


def estimates(n: int, table: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Of each of n files, from the tables of the keys that its strata gave; the highest stratum that fails scales what was
    decoded above it."""
    counts = np.bincount(table, minlength=n * strata.STRATA).reshape(n, -1)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # in this stratum and higher ones
    bad = ~ok.reshape(n, -1)
    top = strata.STRATA - 1 - np.argmax(bad[:, ::-1], axis=1)
    higher = np.append(above, np.zeros((n, 1), dtype=np.int64), axis=1)[np.arange(n), top + 1]
    return np.where(bad.any(axis=1), np.maximum(1, higher) << np.minimum(top + 1, 40), above[:, 0])


class Exchange:
    """What the two sides of a lot of files tell each other: `estimate`, `cells`, `mine` and `theirs` (keys that only the
    sender or the receiver has), and the octets of the sender's sketches."""

    def __init__(self, sides: list[tuple[list[int], list[int]]], factor: float, octets: bool):
        n = len(sides)
        file = np.repeat(np.arange(n), [len(a) + len(b) for a, b in sides])
        keys = np.array([k for a, b in sides for k in (*a, *b)], dtype=np.uint64)
        signs = np.array([s for a, b in sides for s in (*[1] * len(a), *[-1] * len(b))], dtype=np.int64)
        self.octets = [{"strata_octets": 0, "strata_compressed": 0, "table_octets": 0, "table_compressed": 0} for _ in sides]
        levels, hashed = strata_of(file, keys)
        if octets:
            own = signs > 0
            estimators = Tables(np.full(n * strata.STRATA, strata.STRATUM.per_sub)).add(levels[own], hashed[own], signs[own])
            estimators.base = estimators.base[:: strata.STRATA]  # a file's strata follow one another
            self.spend("strata", range(n), estimators.packed(list(range(n))))
        table, _, _, ok = Tables(np.full(n * strata.STRATA, strata.STRATUM.per_sub)).add(levels, hashed, signs).peel()
        self.estimate = estimates(n, table, ok)
        wanted = np.maximum(np.ceil(self.estimate * factor), LEAST_CELLS if factor >= 1 else HASHES)
        per_sub = np.ceil(wanted / HASHES).astype(np.int64)
        self.cells, self.mine, self.theirs = np.zeros(n, dtype=np.int64), [[] for _ in sides], [[] for _ in sides]
        open_ = np.flatnonzero(self.estimate > 0)
        while len(open_):
            self.cells[open_] += HASHES * per_sub[open_]
            number = np.full(n, -1)
            number[open_] = np.arange(len(open_))
            own = number[file] >= 0
            if octets:
                sent = own & (signs > 0)
                self.spend("table", open_, Tables(per_sub[open_]).add(number[file[sent]], keys[sent], signs[sent]).packed(list(range(len(open_)))))
            table, got, sign, ok = Tables(per_sub[open_]).add(number[file[own]], keys[own], signs[own]).peel()
            for t, k, s in zip(table.tolist(), got.view(np.int64).tolist(), sign.tolist(), strict=True):
                if ok[t]:
                    (self.mine if s > 0 else self.theirs)[open_[t]].append(k)
            open_ = open_[~ok]
            per_sub[open_] *= 2

    def spend(self, what: str, files, messages: list[bytes]) -> None:
        for i, x in zip(files, messages, strict=True):
            self.octets[i][f"{what}_octets"] += len(x)
            self.octets[i][f"{what}_compressed"] += len(zlib.compress(x, 9))


def round2_of(data: bytes, found: list[Block], mine: set[int], theirs: set[int]) -> dict:
    """What the sender says of a file.

    hash_exists: of the receiver's keys in their order, whether the sender has them. chunk_exists: of the sender's blocks,
    whether the receiver has them. existing_chunk_encoding: such a block's place among the receiver's keys, or, if the block
    before it exists too, among the shared keys whose blocks begin with the same bytes. new_chunk_info: the other blocks.
    """
    first = first_of_each(found)
    shared = [k for k in first if k not in mine]
    place = {k: i for i, k in enumerate(sorted([*shared, *theirs]))}
    group, near = {}, {}
    for k in shared:
        near[k] = group.setdefault(first[k][3], 0)
        group[first[k][3]] += 1
    new, known, before = [], [], False
    for start, length, key, *_ in found:
        exists = key not in mine
        if exists:
            known.append(near[key] if before else place[key])
        else:
            new.append(data[start : start + length])
        before = exists
    return {"chunk_exists": [b[2] not in mine for b in found], "hash_exists": [k not in theirs for k in place], "new_chunk_info": new, "existing_chunk_encoding": known, "sha1": sha1(data).digest()}


KEYS = [(c, pa.int64()) for c in ("doc_id", "estimate", "cells", "strata_octets", "strata_compressed", "table_octets", "table_compressed")]
SIDES = [("mine", pa.list_(pa.int64())), ("theirs", pa.list_(pa.int64()))]
SAID = [("chunk_exists", pa.list_(pa.bool_())), ("hash_exists", pa.list_(pa.bool_())), ("new_chunk_info", pa.list_(pa.binary())), ("existing_chunk_encoding", pa.list_(pa.int64())), ("sha1", pa.binary())]
ROUND2 = "chunk_exists array<boolean>, hash_exists array<boolean>, new_chunk_info array<binary>, existing_chunk_encoding array<long>, sha1 binary"
#: Files, and bytes of them, whose sketches are worked on together.
LOT_FILES, LOT_BYTES = 128, 4 << 20
#: Files that are put together at once, of a batch that is bounded by bytes.
PART_FILES = 64


def exchanged(files: DataFrame, factor: float = CELLS_PER_KEY, octets: bool = False) -> DataFrame:
    """A row for each file (doc_id, old, new, block, overlap), in one pass: what the sketches gave (estimate, cells, mine, theirs), if
    asked for the octets of the sender's estimators and tables as sent and compressed, and round 2 as ROUND2."""

    def lot(rows: list[dict]) -> pa.RecordBatch:
        found = [[blocks(r[c], r["block"], r["overlap"]) for c in ("new", "old")] for r in rows]
        said = Exchange([tuple(list(first_of_each(x)) for x in both) for both in found], factor, octets)
        out = []
        for i, (r, (new, _)) in enumerate(zip(rows, found, strict=True)):
            sides = {"mine": said.mine[i], "theirs": said.theirs[i]}
            out.append({"doc_id": r["doc_id"], "estimate": int(said.estimate[i]), "cells": int(said.cells[i]), **said.octets[i], **sides, **round2_of(r["new"], new, set(said.mine[i]), set(said.theirs[i]))})
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([*KEYS, *SIDES, *SAID]))

    def work(batches):
        rows, size = [], 0
        for r in rows_of(batches):
            rows.append(r)
            size += len(r["old"]) + len(r["new"])
            if len(rows) == LOT_FILES or size > LOT_BYTES:
                yield lot(rows)
                rows, size = [], 0
        if rows:
            yield lot(rows)
        release()

    return in_small_batches(files).mapInArrow(work, f"{', '.join(f'{c} long' for c, _ in KEYS)}, mine array<long>, theirs array<long>, {ROUND2}")


def differences(told: DataFrame) -> DataFrame:
    """(doc_id, side, key) of what exchanged() gave: A for keys of the new version alone, B for keys of the old one."""
    side = lambda c, s: F.transform(c, lambda k: F.struct(F.lit(s).alias("side"), k.alias("key")))
    return told.select("doc_id", F.explode(F.concat(side("mine", "A"), side("theirs", "B"))).alias("x")).select("doc_id", "x.*")


def round2(told: DataFrame) -> DataFrame:
    return told.select("doc_id", *(c for c, _ in SAID))


def encoded(said: DataFrame) -> DataFrame:
    """(doc_id, octets): round 2 as it is sent."""

    def work(batches):
        for batch in batches:
            octets = [codec.pack_round2(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(octets, pa.binary())], ["doc_id", "octets"])
        release()

    return in_small_batches(said).select("doc_id", *(c for c, _ in SAID)).mapInArrow(work, "doc_id long, octets binary")


def received(messages: DataFrame) -> DataFrame:
    """Round 2 from what encoded() gave."""

    def work(batches):
        for batch in batches:
            rows = [{"doc_id": i, **codec.unpack_round2(x)} for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([KEYS[0], *SAID]))
        release()

    return in_small_batches(messages).select("doc_id", "octets").mapInArrow(work, f"doc_id long, {ROUND2}")


def replayed(old: bytes, average: int, overlap: int, said: dict) -> bytes:
    """The new version, from the old one and what round 2 says."""
    first = first_of_each(blocks(old, average, overlap))
    keys = list(first)
    groups: dict[bytes, list[int]] = {}
    for k, exists in zip(keys, said["hash_exists"], strict=True):
        if exists:
            groups.setdefault(first[k][3], []).append(k)
    out, new, known, before = [], iter(said["new_chunk_info"]), iter(said["existing_chunk_encoding"]), None
    for exists in said["chunk_exists"]:
        if exists:
            at = next(known)
            before = first[keys[at] if before is None else groups[before[4]][at]]
            out.append(old[before[0] : before[0] + before[1]])
        else:
            out.append(next(new))
            before = None
    return b"".join(out)


def rebuilt(files: DataFrame, said: DataFrame) -> DataFrame:
    """(doc_id, content, ok): the new version as the receiver gets it, and whether its hash is the sender's."""
    rows = in_small_batches(files).select(F.col("doc_id").cast("long").alias("doc_id"), "old", "block", "overlap").join(said, "doc_id")

    def work(batches):
        for batch in batches:
            for part in (batch.slice(i, PART_FILES) for i in range(0, batch.num_rows, PART_FILES)):
                each = part.to_pylist()
                contents = [replayed(r["old"], r["block"], r["overlap"], r) for r in each]
                ok = [sha1(x).digest() == r["sha1"] for x, r in zip(contents, each, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(contents, pa.binary()), pa.array(ok)], ["doc_id", "content", "ok"])
        release()

    return rows.mapInArrow(work, "doc_id long, content binary, ok boolean")


def round2_bits() -> Column:
    """Of a row of round 2: a bit for each block and key, the new blocks' bytes, and 32 bits for each place."""
    sent = F.aggregate("new_chunk_info", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))
    return (F.size("chunk_exists") + F.size("hash_exists") + 8 * sent + 32 * F.size("existing_chunk_encoding")).cast("long")


def totals(files: DataFrame, told: DataFrame) -> DataFrame:
    """What is sent for each file, against whole files by zlib: strata_, table_ and round2_octets and as many compressed, and the
    same in bits of information (strata_bits, table_bits, round2_bits). told: what exchanged() gave with octets."""
    size = lambda c: F.octet_length(compressed(F.col(c))).cast("long")
    whole = in_small_batches(files).select("doc_id", size("old").alias("old_compressed"), size("new").alias("new_compressed"))
    second = encoded(told).select("doc_id", F.octet_length("octets").cast("long").alias("round2_octets"), size("octets").alias("round2_compressed"))
    table = (F.col("cells") * iblt.Spec(HASHES, HASHES).size_in_bits() / HASHES).cast("long")
    bits = F.lit(strata.size_in_bits()).cast("long").alias("strata_bits"), table.alias("table_bits"), round2_bits().alias("round2_bits")
    first = told.select("doc_id", "strata_octets", "strata_compressed", "table_octets", "table_compressed", *bits)
    return first.join(second, "doc_id").join(whole, "doc_id")
