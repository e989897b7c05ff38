import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from symdiff.operators import filesync, fingerprint, protocol
from symdiff.plans import catalog


def slow_hashes(data: bytes) -> list[int]:
    signed = [b - 256 if b > 127 else b for b in data]
    return [sum(signed[i - j] * pow(fingerprint.BASE, j) for j in range(min(10, i + 1))) % (1 << 32) for i in range(len(data))]


def slow_winnow(data: bytes, average: int) -> list[tuple[int, int]]:
    w, h, out = 2 * average - 1, slow_hashes(data), []
    for r in range(1, len(data) - w):
        window = [(h[p - 1], -p) for p in range(max(1, r - w + 1), r + 1)]
        value, minus = min(window)
        if (-minus, value) not in out:
            out.append((-minus, value))
    return out


def data_of(n: int, seed: int) -> bytes:
    r = random.Random(seed)
    return bytes(r.choice(b"abcde \xc3\xa9") for _ in range(n))


def test_rolling_hash_closed_form():
    data = data_of(200, 1)
    assert fingerprint.rolling_hashes(data).tolist() == slow_hashes(data)


def test_winnowing_matches_the_sequential_form():
    for seed, (n, average) in enumerate([(300, 5), (300, 20), (15, 10), (0, 5), (40, 20), (41, 20), (500, 1)]):
        data = data_of(n, seed)
        positions, hashes = fingerprint.winnow(data, average)
        assert list(zip(positions.tolist(), hashes.tolist(), strict=True)) == sorted(slow_winnow(data, average))


def test_winnowing_density():
    data = bytes(np.random.default_rng(0).integers(0, 256, 200_000, dtype=np.uint8))
    assert 0.8 < len(fingerprint.winnow(data, 100)[0]) * 100 / len(data) < 1.2


def test_blocks_cover_the_data():
    data = data_of(1000, 3)
    found = fingerprint.blocks(data, 20)
    assert b"".join(data[s : s + n] for s, n, _ in found) == data
    assert fingerprint.blocks(b"", 20) == [] and fingerprint.blocks(b"ab", 20)[0][:2] == (0, 2)


def test_reconstruction_and_plan(spark):
    old = "".join(random.Random(4).choice("abc def") for _ in range(3000))
    new = old[:1200] + "INSERTED" + old[1200:]
    docs = lambda t: spark.createDataFrame([(1, t), (2, "short")], "doc_id long, text string")
    a, b = docs(old), docs(new)
    got = {r.doc_id: r.sha1 for r in filesync.reconstructed(a, b, 30).collect()}
    assert got == {1: hashlib.sha1(new.encode()).hexdigest(), 2: hashlib.sha1(b"short").hexdigest()}
    plan = filesync.sync_plan(fingerprint.digests(a, 30, 1), fingerprint.digests(b, 30, 1))
    sent = plan.where("doc_id = 1 and not exists").agg(F.sum("len")).first()[0]
    assert 8 <= sent < 400
    costs = filesync.sync_bytes(plan).where("doc_id = 1").first()
    assert costs.literal_bytes == sent and costs.plan_bytes > sent


def test_compression_round_trip(spark):
    df = spark.createDataFrame([(b"abc" * 100,), (b"",), (None,)], "d binary")
    out = df.select("d", filesync.decompressed(filesync.compressed("d")).alias("e")).collect()
    assert all(r.d == r.e for r in out)


def test_changed_blocks_do_not_overlap(spark):
    starts = filesync.corrupted_blocks(spark.createDataFrame([(i, 60) for i in range(50)], "doc_id long, n long"), 5, 5).collect()
    for r in starts:
        assert r.starts and all(y - x >= 5 for x, y in zip(r.starts, r.starts[1:], strict=False))


def test_directory_plan(spark):
    files = lambda rows: filesync.manifest(spark.createDataFrame([(p, c.encode()) for p, c in rows], "path string, content binary"))
    mine = files([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), (".h", "5")])
    theirs = files([("a", "1"), ("b", "x"), ("old", "3"), ("e", "9")])
    got = {tuple(r) for r in filesync.directory_plan(mine, theirs).collect()}
    assert got == {("b", "modified", None), ("old", "rename", "c"), ("e", "delete", None), ("d", "new", None)}


def test_jaccard_and_collisions(spark):
    docs = spark.createDataFrame([(1, "abcdefgh" * 50), (2, "abcdefgh" * 50), (3, "zyxwvuts" * 50)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "d1 long, d2 long")
    rows = {(r.d1, r.d2): (r.inter, r.uni) for r in fingerprint.jaccard(pairs, fingerprint.fingerprints(docs, 10)).collect()}
    assert rows[1, 2][0] == rows[1, 2][1] > 0 and rows[1, 3][0] == 0
    assert fingerprint.collisions(docs, 10).isEmpty()


def test_sets_are_joined_whole(spark):
    """Sets made in the pass over the texts give the same as rows of hashes; a pair's hashes are never rows that a task gathers."""
    r = random.Random(5)
    texts = ["".join(r.choices("abcd ", k=n)) for n in (0, 5, 400, 900)] + [None]
    docs = spark.createDataFrame([(i % 9, texts[i % 5] if i % 2 else "".join(r.choices("abcd ", k=300))) for i in range(20)] + [(None, "x" * 500)], "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(10) for b in range(a)], "d1 long, d2 long")
    for sets, rows in ((fingerprint.fingerprint_sets(docs, 10), fingerprint.fingerprints(docs, 10)), (fingerprint.digest_sets(docs, 10), fingerprint.digests(docs, 10))):
        own = {}
        for x in rows.collect():
            own.setdefault(x.doc_id, set()).add(x.h)
        want = sorted((a, b, len(own.get(a, set()) & own.get(b, set())), len(own.get(a, set()) | own.get(b, set()))) for a in range(10) for b in range(a) if own.get(a) or own.get(b))
        assert want and sorted(map(tuple, fingerprint.jaccard(pairs, sets).collect())) == want == sorted(map(tuple, fingerprint.jaccard(pairs, rows).collect()))


def test_rows_of_texts_come_in_bounded_slices(spark, monkeypatch):
    """Batches between Spark and Python are small for document queries, whatever the session's limit was."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    fingerprint.named_blocks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 10)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_a_plan_shuffles_blocks_once(spark):
    """Both versions' blocks are dealt by document together; ranks, neighbours and costs follow without another shuffle."""
    docs = spark.createDataFrame([(i, "ab" * i) for i in range(20)], "doc_id long, text string")
    plan = filesync.sync_plan(fingerprint.digests(docs, 10, 1), fingerprint.digests(docs, 10, 1))
    for df in (plan, filesync.sync_bytes(plan)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") <= 2


def test_files_come_in_small_batches(spark):
    for make in (protocol_files, lambda s: catalog.QUERIES["zlib_roundtrip"](s, "/root/testdata/sf0.001")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        make(spark)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def protocol_files(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    return protocol.paired(docs, docs)


def test_corrupted_contents(spark):
    docs = [(i, "é" * 10 + "abc" * (40 * i)) for i in range(1, 30)] + [(100, ""), (101, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in filesync.similar_files(df, 0.05, 3).collect():
        old = (dict(docs)[r.doc_id] or "").encode()
        at = [i for i, (x, y) in enumerate(zip(old, r.content, strict=True)) if x != y]
        assert r.n_changed == len(at) and all(r.content[i] == (old[i] + 1) % 256 for i in at)
        assert len(at) <= 0.2 * len(old)
    blocks = {r.doc_id: r for r in filesync.block_changed_files(df, 5, 5, 13).collect()}
    assert set(blocks) == set(range(1, 30))
    for i, r in blocks.items():
        old = dict(docs)[i].encode()
        assert sum(x != y for x, y in zip(old, r.content, strict=True)) == 5 * r.n_blocks and 1 <= r.n_blocks <= 5
