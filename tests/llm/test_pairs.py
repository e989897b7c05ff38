"""Operators on pairs against all pairs, and the pipeline."""

import collections
import os
import random
import subprocess
import sys

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from symdiff.llm import common, minhash, pivots
from symdiff.llm import components as components_module
from symdiff.llm.components import components, extended

pytest.importorskip("public_tokenizers")


def smallest(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(3, 3)]
    real = [(a, b) for a, b in edges if a != b]
    want = smallest({x for e in real for x in e}, real)
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.id: x.component for x in found.collect()} == want
    more = [(5, 100), (130, 205)]
    got = extended(found, spark.createDataFrame(more, "a long, b long"))
    assert {x.id: x.component for x in got.collect()} == smallest({x for e in real + more for x in e}, real + more)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return frozenset([b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else [])


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(spark, words, percent):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    docs, texts = [], []
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 8, 40, 150]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(own).upper() if r.random() < 0.2 else "\t".join(own))
    texts += ["", None, "one", "ONE ", "one two"] + [texts[0]] * 30
    docs = list(enumerate(texts))
    sets = {i: shingles(t, words) for i, t in docs}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = smallest(sets, links)
    got = minhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), words=words, percent=percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


@pytest.mark.parametrize("vocabulary", [10**9, 60])
def test_template_families_match_all_pairs(spark, monkeypatch, vocabulary):
    """One form of 100 words with four fields each: documents lie below the threshold, but for those that share two."""
    monkeypatch.setattr(minhash, "BLOCK", 16, raising=False)
    r = random.Random(7)
    form = [f"form{k}" for k in range(96)]
    fields = [[r.randrange(vocabulary) for _ in range(4)] for _ in range(300)]
    for k in range(0, 40, 2):
        fields[k + 1][:2] = fields[k][:2]
    docs = []
    for i in r.sample(range(300), 300):
        text = list(form)
        for at, x in zip((80, 60, 40, 20), fields[i], strict=True):
            text.insert(at, f"field{at}x{x}")
        docs.append((len(docs), " ".join(text)))
    sets = {i: shingles(t, 3) for i, t in docs}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = smallest(sets, links)
    got = minhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), words=3, percent=85).collect()
    assert len(set(want.values())) > 50 and len(links) >= 20
    assert {x.doc_id: x.component_id for x in got} == want


def test_members_of_mixed_buckets_are_written_once(spark, monkeypatch):
    """However many stars a bucket gets, and in proportion to a family of which no two forms are linked, but for two copies."""
    rows, write = [], minhash.written

    def written(df):
        out = write(df)
        rows.append(out.count() if {"key", "parts"} <= set(out.columns) else 0)
        return out

    monkeypatch.setattr(minhash, "written", written)
    r, made = random.Random(3), []
    for n in (60, 120):
        texts = [[x for k in range(24) for x in (*(f"form{k}x{j}" for j in range(4)), *([f"field{r.random()}"] if k % 6 == 2 else []))] for _ in range(n)]
        texts.append([*texts[7], "end"])
        rows.clear()
        got = minhash.near_dedup(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), words=3, percent=85).collect()
        assert {x.doc_id: x.component_id for x in got} == {i: 7 if i == n else i for i in range(n + 1)}
        in_buckets, *in_mixed = [x for x in rows if x]
        assert 10 * n < sum(in_mixed) <= in_buckets
        made.append(sum(in_mixed))
    assert made[1] < 3 * made[0]


@pytest.mark.parametrize("block", [3, 512])
def test_one_id_with_two_texts_in_every_order(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(12)
    a, b = ([f"{x}{r.randrange(10**6)}" for _ in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (None, " ".join(a)), (None, None), (4, None), (5, ""), (0, "other text")]
    rows += [(7, " ".join(b))] * 5 + [(6, " ".join(a))] * 4
    for some in (rows, rows[::-1], r.sample(rows, len(rows))):
        got = minhash.near_dedup(spark.createDataFrame(some, "doc_id long, text string").repartition(3), words=3, percent=85).collect()
        assert len(got) == len(rows)
        assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 1, 3: 1, 6: 1, 7: 1, None: None, 4: 4, 5: 5, 0: 0}
        assert {x.doc_id for x in got if not x.kept} == {2, 3, 6, 7}


def test_bands_keep_misses_rare():
    for percent in (70, 80, 85, 90):
        rows = minhash.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (minhash.BINS // rows) <= minhash.MISS


def test_densified_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    bands = minhash.Bands(85)
    for n in (1, 5, 60, 2000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: max(1, 9 * n // 10)], r.integers(0, 1 << 63, n // 10, dtype=np.uint64))))
        both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((bands.signature(a) == bands.signature(b)).mean() - both) < 0.2


def vectors():
    r = np.random.default_rng(4)
    rows = []
    for k in range(300):
        rows.append(r.standard_normal(16))
        if k % 10 == 0:
            rows += [rows[-1] + 0.08 * r.standard_normal(16) for _ in range(4)]
    return rows + [rows[0]] * 20


def test_embeddings_match_all_pairs(spark):
    found = vectors()
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(found)]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] + [1.0] * 15, 1), (9003, [None] + [1.0] * 15, 1), (9004, [], 1), (9005, [1.0, 0.0], 1), (9006, [1.0, 0.01], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, unit int")
    unit = np.array([v / np.linalg.norm(v) for v in found])
    near = unit @ unit.T >= 0.9
    links = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    want = smallest(range(len(found)), links)
    got = {x.vec_id: x for x in pivots.embedding_near_dedup(df).collect()}
    true = sum(near[i].sum() - 1 for i in range(len(found)))
    have = sum(got[i].n_links for i in range(len(found)))
    assert 0.9 * true <= have <= true and all(got[i].n_links <= near[i].sum() - 1 for i in range(len(found)))
    assert sum(got[i].component_id == want[i] for i in want) >= 0.97 * len(want)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(9000, 9005))
    assert (got[9005].n_links, got[9006].component_id, got[9006].kept) == (1, 9005, False)
    assert pivots.embedding_near_dedup(df.limit(0)).count() == 0


def all_links(v, threshold=0.9):
    near = v @ v.T >= threshold
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize(("dimensions", "block"), [(64, 512), (256, 7)])
def test_embeddings_near_the_threshold_and_in_dense_groups(spark, monkeypatch, dimensions, block):
    """Pairs just above the threshold are found by 95 %; groups of any spread by nearly all, and no link is made up."""
    monkeypatch.setattr(pivots, "BLOCK", block)
    r = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, u = unit(r.standard_normal((700, dimensions))), r.standard_normal((700, dimensions))
    u = unit(u - (u * a).sum(1, keepdims=True) * a)
    c = r.uniform(0.9, 0.92, (700, 1))
    groups = [unit(unit(r.standard_normal((1, dimensions))) + s * unit(r.standard_normal((n, dimensions)))) for s, n in ((0.1, 150), (0.2, 150), (0.3, 150), (0.4, 80))]
    v = np.concatenate((a, c * a + np.sqrt(1 - c * c) * u, *groups))
    near = all_links(v)
    rows = [(i, x.tolist(), 0, 1.0) for i, x in enumerate(v)]
    got = {x.vec_id: x for x in pivots.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rows int, cosine double").repartition(5)).collect()}
    have = np.array([got[i].n_links for i in range(len(v))])
    assert (have <= near.sum(1)).all()
    assert have[:1400].sum() >= 0.95 * near[:1400].sum() and have[1400:].sum() >= 0.97 * near[1400:].sum()
    want = smallest(range(len(v)), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    assert sum(got[i].component_id == want[i] for i in range(len(v))) >= 0.95 * len(v)
    assert all(x.kept == (x.component_id == i) for i, x in got.items())


@pytest.mark.parametrize("block", [2, 512])
def test_one_vector_id_with_two_vectors_in_every_order(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    r = np.random.default_rng(6)
    a, b = r.standard_normal((2, 16))
    near = lambda x: (x + 0.01 * r.standard_normal(16)).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (2, near(a)), (3, near(b)), (4, r.standard_normal(16).tolist()), (None, a.tolist()), (None, None), (5, []), (6, [0.0] * 16), (7, [1.0, 2.0]), (8, [2.0, 4.1]), (9, [None, 1.0])]
    rows += [(10, b.tolist())] * 4 + [(11, [float("inf")] * 16)]
    for some in (rows, rows[::-1]):
        got = pivots.embedding_near_dedup(spark.createDataFrame(some, "vec_id long, embedding array<double>").repartition(3)).collect()
        links = collections.Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in got)
        assert links == collections.Counter(
            [(1, 1, 1, True), (1, 5, 1, True), (2, 1, 1, False), (3, 5, 1, False), (4, 0, 4, True), (7, 1, 7, True), (8, 1, 7, False), *[(10, 5, 1, False)] * 4]
            + [(i, 0, i, True) for i in (None, None, 5, 6, 9, 11)]
        )


FRESH = """
import struct
from pyspark.sql import SparkSession
from symdiff.llm.pivots import with_cosine

conf = {"spark.ui.enabled": "false", "spark.python.worker.reuse": "false"}
spark = SparkSession.builder.master("local[1]").config(map=conf).getOrCreate()
rows = [(1, bytearray(struct.pack("2d", 1, 0)), bytearray(struct.pack("2d", 0.6, 0.8))), (2, bytearray(struct.pack("d", 1)), bytearray(struct.pack("2d", 1, 0)))]
print(sorted(tuple(r) for r in with_cosine(spark.createDataFrame(rows, "k int, x binary, y binary"), ["k"]).collect()))
"""


def test_cosines_in_a_worker_that_has_run_nothing_else():
    """A worker imports only what its function names; modules that it loaded before would hide what is missing."""
    done = subprocess.run([sys.executable, "-c", FRESH], capture_output=True, text=True, timeout=180, env={**os.environ, "PYTHONPATH": os.pathsep.join(sys.path)})
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.strip().endswith("[(1, 0.6), (2, -1.0)]")


def test_pivots_grow_with_the_table():
    counts = [pivots.pivot_count(n) for n in (0, 50_000, 10**7, 10**9, 10**12)]
    assert counts == sorted(counts) and counts[0] == 192 and counts[2] > 700 and counts[-1] == pivots.MOST_PIVOTS
    assert [pivots.nearest_of(n) for n in (1, 192, 600, 2304)] == sorted(pivots.nearest_of(n) for n in (1, 192, 600, 2304))


def corpus(spark, path):
    r = random.Random(5)
    words = [a + b for a in "the and house with thing paper stone river".split() for b in ["", "s", "ing", "er", "ly", "ed", "al", "or"]]
    docs = []
    for i in range(240):
        text = [r.choice(words) for _ in range(60)]
        if i % 6 == 0:
            text[10:10] = ["nasty", "awful"]
            text[40:40] = ["nasty"]
        docs.append([i, " ".join(text)])
    docs[7][1] += " password = hunter2hunter2"
    docs[11][1] = docs[9][1]
    docs[13][1] = docs[9][1] + " end"
    docs += [[500, None], [501, "12345 !!"], [502, docs[8][1]], [502, docs[8][1]]]
    rows = [(i, t, "en", "src", len(t) if t else None) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {i: t for i, t in docs}


def test_pipeline_stages_take_effect(spark, tmp_path):
    texts = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "packing" or docs.columns == columns
        kept.append(docs)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] == set(texts) - {500, 501}
    toxic = {i for i in range(240) if i % 6 == 0}
    assert len(ids[0] - ids[1] - toxic) <= 3 and len(toxic & ids[1]) <= 3
    assert {9, 11, 13} & ids[2] == {9} and 502 not in ids[2] and len(ids[1] - ids[2]) <= 5
    assert kept[2].groupBy("doc_id").count().where("count > 1").isEmpty()
    redacted = {r.doc_id: r for r in kept[3].collect()}
    assert "[ASSIGN]" in redacted[7].text and "hunter2" not in redacted[7].text and redacted[7].n_chars == len(redacted[7].text)
    assert all(r.text == texts[i] for i, r in redacted.items() if i != 7)
    assert ids[4] == ids[3]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.columns == kept[4].columns
    # where documents are cut depends on their order; what is packed doesn't
    packed = [{tuple(r) for r in d.groupBy("doc_id", "doc_tokens").sum("length").collect()} for d in (run, kept[4])]
    assert packed[0] == packed[1] and {r[0] for r in packed[0]} == ids[4] and all(r[1] == r[2] for r in packed[0])


def test_pipeline_drops_texts_of_no_known_language(spark):
    r = random.Random(8)
    words = "the and house with thing paper stone river".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([2, 10, 60]))), "en") for i in range(400)]
    odd = ["Привет мир это обычный русский текст про дом и улицу " * 5, "0x7f 3c e2 88 12 9a ff 00 1c 5b " * 10, "x " + "12 34 56 " * 40 + "q 7", "12345"]
    odd += ["zxqv kwjp qqzz vvkk xxjq zzwk " * 10]
    docs = spark.createDataFrame(rows + [(1000 + k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert {i for i, _, _ in rows} <= kept and not kept & {1000, 1001, 1003, 1004}
    judged = {x.doc_id: x for x in corpus_pipeline.langid.identify_language(docs).collect()}
    assert {i for i, x in judged.items() if x.known} == kept and judged[1000].lang_pred == "en"


def test_pipeline_stages_on_edges_and_empty_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, very long texts, columns that stages might make themselves; nothing at all."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    long = "some words that go on and on " * 20_000
    rows = [(1, "some words in a text", "en", 1, 1), (1, "some words in a text", "en", 1, 2), (2, None, None, None, 3), (None, "other words without an id", "en", 2, 4), (3, "", "en", 3, 5), (4, long, "en", 4, None), (5, "12 34", None, 5, 6)]
    schema = "doc_id long, text string, lang string, judged int, toxicity int"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema).withColumns({"n_chars": F.length("text").cast("long"), "kept": F.lit(1), "rows": F.lit("x"), "id": F.col("doc_id")})
        columns, counts = docs.columns, []
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, str(tmp_path)))
            assert name == "packing" or docs.columns == columns
            counts.append(docs.count())
        assert counts[:4] == ([4, 4, 3, 3] if data else [0] * 4) and (counts[4] >= 3) == bool(data)
        if data:
            assert {(r.doc_id, r.doc_tokens) for r in docs.collect()} >= {(1, 6), (None, 6)}


def test_pipeline_without_languages_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, "\u041f\u0440\u0438", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {1, 3}


def test_joins_of_hot_keys_lose_nothing(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 1), (1, 5), (1, 5)], "k long, v long")
    table = spark.createDataFrame([(i, f"x{i}") for i in range(0, 300, 2)] + [(1, "hot")], "k long, name string")
    want = sorted(tuple(r) for r in rows.join(table, "k").collect())
    for block in (1, 7, 10_000):
        joined = common.spread_join(rows, table, "k", block)
        assert joined.columns == ["k", "v", "name"] and sorted(tuple(r) for r in joined.collect()) == want


def test_components_of_large_stars(spark, monkeypatch):
    monkeypatch.setattr(components_module, "BLOCK", 3)
    edges = [(0, i) for i in range(1, 40)] + [(i, 39) for i in range(40, 80)] + [(100, 101)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(80)}, 100: 100, 101: 100}
