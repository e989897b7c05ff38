"""Octets of sketches: an identity there and back, against a byte-by-byte encoder."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symdiff.operators import codec, iblt

UNSIGNED = st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 64) - 1), st.sampled_from([127, 128, 16383, 16384, (1 << 63) - 1, 1 << 63])))


def one_by_one(values):
    out = bytearray()
    for x in values:
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out)


@settings(max_examples=200, deadline=None)
@given(UNSIGNED)
def test_integers(values):
    array = np.array(values, dtype=np.uint64)
    data = codec.varints(array)
    assert data == one_by_one(values) and codec.integers(data).tolist() == values
    assert codec.octets_of(array).sum() == len(data)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1)))
def test_signed_integers(values):
    assert codec.unzigzag(codec.zigzag(np.array(values, dtype=np.int64))).tolist() == values


def test_small_numbers_are_short():
    assert codec.zigzag(np.array([0, -1, 1, -2])).tolist() == [0, 1, 2, 3]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 1 << 20), st.tuples(st.integers(0, (1 << 64) - 1), st.integers(0, (1 << 64) - 1), st.integers(-(1 << 40), 1 << 40))))
def test_cells(cells):
    at = sorted(cells)
    columns = [np.array([cells[p][k] for p in at], dtype=t) for k, t in enumerate((np.uint64, np.uint64, np.int64))]
    got = codec.unpack_cells(codec.pack_cells(np.array(at, dtype=np.int64), *columns))
    assert [x.tolist() for x in got] == [at, *(c.tolist() for c in columns)]


@pytest.mark.parametrize("data", [b"\x80", b"\x05ab", b"\x01\x01\x01\x01\x02\x01\x01\x01\x00"])
def test_broken_messages_are_errors(data):
    with pytest.raises(ValueError):
        codec.integers(data) if data == b"\x80" else codec.unpack_cells(data)


def test_round_two():
    rng = random.Random(1)
    for n in (0, 1, 8, 77):
        said = {"chunk_exists": [rng.random() < 0.5 for _ in range(n)], "hash_exists": [rng.random() < 0.5 for _ in range(n // 2)], "new_chunk_info": [rng.randbytes(rng.choice([0, 1, 300])) for _ in range(n)], "existing_chunk_encoding": [rng.randrange(1 << 20) for _ in range(n)], "sha1": rng.randbytes(20)}
        assert codec.unpack_round2(codec.pack_round2(said)) == said


def test_tables_of_several_segments_and_groups(spark, monkeypatch):
    monkeypatch.setattr(codec, "SEGMENT", 50)
    spec = iblt.Spec(400, 4, "portable")
    keys = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919).alias("key"), F.when(F.col("id") % 5 == 0, -1).otherwise(1).alias("sign"))
    cells = iblt.build(keys, spec, "g")
    packed = codec.packed(cells, spec, "g")
    assert packed.select("segment").distinct().count() == 8
    assert sorted(map(tuple, codec.unpacked(packed, spec, "g").collect())) == sorted(map(tuple, cells.collect()))
    assert codec.unpacked(codec.packed(cells.where("false"), spec, "g"), spec, "g").count() == 0
