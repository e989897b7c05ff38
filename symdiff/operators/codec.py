"""Sketches as octets: variable-length integers for cells, estimators and the second round's messages.

An integer takes 7 bits an octet, lowest first, with the highest bit set on all but the last octet; signed ones are
zigzagged (0, -1, 1, -2, ...). Whole columns are coded at once. A message of cells is four columns, each behind its length in octets: the steps between cells'
positions, keys, checksums and counts. A cell's position is sub * per_sub + cell; an estimator's strata follow one another.

A DataFrame's tables are cut into segments of SEGMENT positions, a row each, so no task packs more than that at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdiff.operators import iblt

#: Positions of a table that share a row.
SEGMENT = 1 << 16
LIMITS = np.array([1 << 7 * k for k in range(1, 10)], dtype=np.uint64)


def octets_of(values: np.ndarray) -> np.ndarray:
    """How many octets each takes."""
    return np.searchsorted(LIMITS, values.astype(np.uint64), "right") + 1


def varints(values: np.ndarray) -> bytes:
    values = values.astype(np.uint64)
    sizes = octets_of(values)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        low = (values[some] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8)
        out[(ends - sizes)[some] + k] = low | ((sizes[some] > k + 1) << 7).astype(np.uint8)
    return out.tobytes()


def integers(data: bytes) -> np.ndarray:
    """What varints() was made of."""
    octets = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(octets < 0x80)
    if len(octets) and (not len(last) or last[-1] != len(octets) - 1):
        raise ValueError("the octets end within an integer")
    first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
    out = np.zeros(len(last), dtype=np.uint64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        some = first + k <= last
        out[some] |= (octets[first[some] + k] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * k)
    return out


def zigzag(values: np.ndarray) -> np.ndarray:
    return ((values << 1) ^ (values >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def framed(parts: list[bytes]) -> bytes:
    """Parts, each behind its length."""
    return b"".join(x for p in parts for x in (varints(np.array([len(p)])), p))


def parts_of(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = at
        while data[end] & 0x80:
            end += 1
        n = int(integers(data[at : end + 1])[0])
        if end + 1 + n > len(data):
            raise ValueError("the octets end within a part")
        yield data[end + 1 : end + 1 + n]
        at = end + 1 + n


def pack_cells(positions: np.ndarray, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray) -> bytes:
    """Positions rise; keys and checks are unsigned or the same bits."""
    steps = np.diff(positions.astype(np.int64), prepend=-1) - 1
    return framed([varints(steps), varints(keys.view(np.uint64)), varints(checks.view(np.uint64)), varints(zigzag(counts.astype(np.int64)))])


def unpack_cells(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    steps, keys, checks, counts = map(integers, parts_of(data))
    if not len(steps) == len(keys) == len(checks) == len(counts):
        raise ValueError("the columns differ in length")
    return np.cumsum(steps.astype(np.int64) + 1) - 1, keys, checks, unzigzag(counts)


def pack_round2(said: dict) -> bytes:
    """A row of the protocol's second round: two lists of bits, places, blocks one after another, and a digest."""
    bits = [np.packbits(np.array(said[c], dtype=bool), bitorder="little").tobytes() for c in ("chunk_exists", "hash_exists")]
    sizes = np.array([len(said["chunk_exists"]), len(said["hash_exists"])])
    blocks = said["new_chunk_info"]
    return framed([varints(sizes), *bits, varints(np.array(said["existing_chunk_encoding"], dtype=np.int64)), varints(np.array([len(x) for x in blocks], dtype=np.int64)), b"".join(blocks), said["sha1"]])


def unpack_round2(data: bytes) -> dict:
    sizes, chunks, hashes, places, lengths, blocks, digest = parts_of(data)
    bits = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=int(n), bitorder="little").astype(bool).tolist() for x, n in zip((chunks, hashes), integers(sizes), strict=True)]
    ends = np.cumsum(integers(lengths).astype(np.int64)).tolist()
    new = [blocks[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return {"chunk_exists": bits[0], "hash_exists": bits[1], "new_chunk_info": new, "existing_chunk_encoding": integers(places).astype(np.int64).tolist(), "sha1": digest}


def position(spec: iblt.Spec, stratum: Column | None = None) -> Column:
    at = F.col("sub") * F.lit(spec.per_sub) + F.col("cell")
    return (at if stratum is None else stratum * F.lit(spec.m) + at).cast("long")


def packed(cells: DataFrame, spec: iblt.Spec, *groups: str, strata: bool = False) -> DataFrame:
    """(groups..., segment, octets) of tables (groups..., sub, cell, key_sum, hash_sum, cnt); strata: of estimators, whose cells have a
    column `stratum`."""
    rows = cells.withColumn("at", position(spec, F.col("stratum") if strata else None)).withColumn("segment", F.floor(F.col("at") / SEGMENT).cast("long"))
    kinds = dict(cells.dtypes)

    def work(some: pa.Table) -> pa.Table:
        some = some.sort_by("at")
        at, *sums = (some.column(c).to_numpy() for c in ("at", *iblt.SUMS))
        octets = pack_cells(at - at[0] // SEGMENT * SEGMENT, *sums)
        return pa.table({**{c: some.column(c).slice(0, 1) for c in (*groups, "segment")}, "octets": pa.array([octets], pa.binary())})

    schema = ", ".join([*(f"{g} {kinds[g]}" for g in groups), "segment long, octets binary"])
    return rows.select(*groups, "segment", "at", *iblt.SUMS).groupBy(*groups, "segment").applyInArrow(work, schema)


def unpacked(messages: DataFrame, spec: iblt.Spec, *groups: str, strata: bool = False) -> DataFrame:
    """The cells that packed() was made of."""
    kinds = dict(messages.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (segment, octets) in enumerate(zip(batch.column(len(groups)).to_pylist(), batch.column(len(groups) + 1).to_pylist(), strict=True)):
                at, keys, checks, counts = unpack_cells(octets)
                at = at + segment * SEGMENT
                kept = [batch.column(k).take(pa.array(np.full(len(at), i))) for k in range(len(groups))]
                rest = at % spec.m if strata else at
                columns = [pa.array(x) for x in ((rest // spec.per_sub).astype(np.int32), (rest % spec.per_sub).astype(np.int32), keys.view(np.int64), checks.view(np.int64), counts)]
                level = [pa.array((at // spec.m).astype(np.int32))] if strata else []
                yield pa.RecordBatch.from_arrays([*kept, *level, *columns], [*groups, *(["stratum"] if strata else []), "sub", "cell", *iblt.SUMS])

    schema = ", ".join([*(f"{g} {kinds[g]}" for g in groups), *(["stratum int"] if strata else []), "sub int, cell int, key_sum long, hash_sum long, cnt long"])
    return messages.select(*groups, "segment", "octets").mapInArrow(work, schema)
