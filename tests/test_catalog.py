"""Every query with SQL gives the same rows as DuckDB, on the smallest tables."""

import functools
import math
import operator
import os
import zlib

import duckdb
import pytest

from symdiff.operators import strata
from symdiff.plans import catalog

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIRECTORY}/{t}.parquet'")
    return connection


def rounded(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda x: f"{x:.6f}" if isinstance(x, float) and not math.isnan(x) else str(x)
    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DIRECTORY)
    want = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rounded([tuple(r) for r in got.collect()], got.columns) == rounded(want.fetchall(), columns)


def test_every_query_without_sql_is_listed():
    """Each of them has a test of its own, below or beside its operator's."""
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set("iblt_fill_ratio strata_accuracy strata_estimate bob_hash superfast_hash tabulation_hash tabulation_text file_sync_totals gossip_rounds gossip_retrieved".split())


def test_text_hashes_match_scalar_ones(spark):
    names = {r.p_partkey: r.p_name.encode() for r in spark.read.parquet(f"{DIRECTORY}/part.parquet").collect()}
    assert {r.p_partkey: r.h for r in catalog.QUERIES["murmur2_32_text"](spark, DIRECTORY).collect()} == {k: murmur32(x) for k, x in names.items()}
    assert {r.p_partkey: r.h for r in catalog.QUERIES["superfast_hash"](spark, DIRECTORY).collect()} == {k: superfast(x) for k, x in names.items()}
    assert {r.p_partkey: (r.h, r.h1, r.h2) for r in catalog.QUERIES["bob_hash"](spark, DIRECTORY).collect()} == {k: (lookup3(x)[0], *lookup3(x)) for k, x in names.items()}
    tables = twister(0, 16 * 65536)
    chunk = lambda x, i: x[2 * i] | x[2 * i + 1] << 8
    assert {r.p_partkey: int(r.h) for r in catalog.QUERIES["tabulation_text"](spark, DIRECTORY).collect()} == {
        k: functools.reduce(operator.xor, (tables[i * 65536 + chunk(x.ljust(32), i)] for i in range(16))) for k, x in names.items()
    }
    for r in catalog.QUERIES["tabulation_hash"](spark, DIRECTORY).limit(200).collect():
        assert int(r.h) == functools.reduce(operator.xor, (tables[i * 65536 + (r.key >> 16 * i & 0xFFFF)] for i in range(4)))


def murmur32(x):
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = len(x)
    for at in range(0, len(x) - len(x) % 4, 4):
        k = int.from_bytes(x[at : at + 4], "little") * m & mask
        h = (h * m & mask) ^ ((k ^ k >> 24) * m & mask)
    if len(x) % 4:
        h = (h ^ int.from_bytes(x[len(x) - len(x) % 4 :], "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


def superfast(x):
    mask, h = 0xFFFFFFFF, len(x)
    two = lambda at: int.from_bytes(x[at : at + 2], "little")
    signed = lambda at: x[at] - 256 * (x[at] > 127)
    end = len(x) - len(x) % 4
    for at in range(0, end, 4):
        h = h + two(at) & mask
        h = (h << 16 & mask) ^ (two(at + 2) << 11) ^ h
        h = h + (h >> 11) & mask
    for length, last, turn, down in ((3, lambda: signed(end + 2) << 18, 16, 11), (2, lambda: 0, 11, 17), (1, lambda: 0, 10, 1)):
        if len(x) % 4 == length:
            h = h + (two(end) if length > 1 else signed(end)) & mask
            h = h ^ (h << turn & mask) ^ (last() & mask)
            h = h + (h >> down) & mask
    for left, right in ((3, 5), (4, 17), (25, 6)):
        h = h ^ (h << left & mask)
        h = h + (h >> right) & mask
    return h


def lookup3(x):
    mask = 0xFFFFFFFF
    turn = lambda v, k: (v << k | v >> 32 - k) & mask
    a = b = c = 0xDEADBEEF + len(x) & mask
    while len(x) > 12:
        a, b, c = (v + int.from_bytes(x[4 * i : 4 * i + 4], "little") & mask for i, v in enumerate((a, b, c)))
        for k in (4, 6, 8, 16, 19, 4):
            a, b, c = b, c + b & mask, (a - c & mask) ^ turn(c, k)
        x = x[12:]
    if x:
        x = x.ljust(12, b"\0")
        a, b, c = (v + int.from_bytes(x[4 * i : 4 * i + 4], "little") & mask for i, v in enumerate((a, b, c)))
        for k in (14, 11, 25, 16, 4, 14, 24):
            a, b, c = b, (c ^ b) - turn(b, k) & mask, a
        return b, a
    return c, b


def twister(seed, n):
    mask, state = (1 << 64) - 1, [seed]
    for i in range(1, 312):
        state.append(6364136223846793005 * (state[-1] ^ state[-1] >> 62) + i & mask)
    out = []
    while len(out) < n:
        for i in range(312):
            x = (state[i] & 0xFFFFFFFF80000000) | (state[(i + 1) % 312] & 0x7FFFFFFF)
            state[i] = state[(i + 156) % 312] ^ x >> 1 ^ (0xB5026F5AA96619E9 if x & 1 else 0)
        for y in state:
            y ^= y >> 29 & 0x5555555555555555
            y ^= y << 17 & 0x71D67FFFEDA60000
            y ^= y << 37 & 0xFFF7EEE000000000
            out.append(y ^ y >> 43)
    return out[:n]


def test_strata_estimates_are_near(spark):
    for r in catalog.QUERIES["strata_estimate"](spark, DIRECTORY).collect():
        assert r.actual / 2 <= r.estimate <= 2 * r.actual
    for r in catalog.QUERIES["strata_accuracy"](spark, DIRECTORY).collect():
        assert 0.4 <= r.ratio <= 2.5 and (r.actual > 50 or r.estimate == r.actual)


def test_tables_give_back_keys_up_to_their_limit(spark):
    shares = {r["keys"]: r.percent_peeled for r in catalog.QUERIES["iblt_fill_ratio"](spark, DIRECTORY).collect()}
    assert shares[2048] == max(shares.values()) and shares[2560] > 0.99 * shares[2048] and shares[4096] < 0.5 * shares[2048]


def test_totals_of_the_protocol(spark, db):
    want = dict(db.execute(catalog.ORACLES["file_sync_round2_bits"]).fetchall())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in catalog.QUERIES["file_sync_totals"](spark, DIRECTORY).collect()}
    assert {k: r.round2_bits for k, r in rows.items()} == want
    for k, r in rows.items():
        assert r.old_compressed == len(zlib.compress(texts[k].encode(), 9)) and r.strata_bits == strata.size_in_bits()
        assert r.table_bits % 160 == 0 and (r.table_bits == 0 or r.table_bits >= 80 * 160)


def test_gossip_without_sql(spark):
    rounds = catalog.QUERIES["gossip_rounds"](spark, DIRECTORY).collect()
    assert len({r.rounds for r in rounds}) == 1 and 1 <= rounds[0].rounds <= 25 and len({r.node for r in rounds}) == 25
    got = catalog.QUERIES["gossip_retrieved"](spark, DIRECTORY)
    assert got.count() > 0


def test_entry_works_without_the_training_data_operators(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())
