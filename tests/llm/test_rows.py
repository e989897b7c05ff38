"""Row-local operators against brute force, and every operator's edge cases."""

import collections
import gc
import hashlib
import random
import re
import time
import tracemalloc
import types
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from symdiff.functions import arrow
from symdiff.llm import common, html, langid, minhash, packing, quality, secrets, sentencepiece, toxicity, trigrams, urls
from symdiff.llm.minhash import near_dedup
from symdiff.llm.pivots import embedding_near_dedup

tokenizers = pytest.importorskip("public_tokenizers")
WORD_MODEL, PIECE_MODEL = tokenizers.path("word_bpe_49k.json"), tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor " * 4000

# Columns that operators make themselves are there already, in other types.
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", 1, 1, True),
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", 1, 1, True),
    (2, None, None, None, None, None),
    (3, "", "en", 0, 0, False),
    (4, " \t\n ", None, 0, 1, True),
    (5, LONG, "xx", 1, 0, True),
    (6, "漢字 ñ 😀", "en", 1, 0, None),
    (None, "a document without an id", "en", None, 1, True),
]
SCHEMA = "doc_id long, text string, lang string, score int, id int, kept boolean"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "secrets": lambda d: secrets.scan_secrets(d),
        "quality": lambda d: quality.judge_quality(d, labels),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "near_dedup": lambda d: near_dedup(d, words=3, percent=85),
        "language": lambda d: langid.identify_language(d),
        "sentencepiece": lambda d: sentencepiece.encode_documents(d, PIECE_MODEL),
        "urls": lambda d: urls.filter_urls(d, "doc_id", "text"),
        "html": lambda d: html.extract_text(d.withColumn("url", F.lit("u")), "doc_id", "url", "text"),
    }


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_one_row_per_row_whatever_it_holds(spark, edges, labels, name):
    out = operators(labels)[name](edges).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(r[0] for r in EDGES)


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_empty_tables(spark, edges, labels, name):
    assert operators(labels.limit(0))[name](edges.limit(0)).count() == 0


def test_packing_of_edges_and_empty_tables(edges):
    assert packing.pack(edges.limit(0), WORD_MODEL).count() == 0
    rows = packing.pack(edges, WORD_MODEL).collect()
    check_packed(rows, [(r[0], r[1]) for r in EDGES])


def check_packed(rows, documents):
    tokenizer = packing.WordTokenizer(WORD_MODEL).tokenizer
    need = collections.Counter()
    for doc, text in documents:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        need[doc, len(ids) // 4] += len(ids) // 4
    for r in rows:
        need[r.doc_id, r.doc_tokens] -= r.length
    assert not any(need.values())
    by_doc = {doc: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for doc, text in documents}
    sequences = collections.defaultdict(list)
    for r in rows:
        assert crc32(by_doc[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0


def test_packing_cuts_and_fills(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "x1", "don't", "Été.", "naïve!!"]) for _ in range(r.choice([1, 30, 700, 3000])))) for i in range(60)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id"), WORD_MODEL).collect()
    check_packed(rows, docs)
    loads = collections.Counter()
    for x in {(r.sequence_id, r.window, r.step_group) for r in rows}:
        loads[x[2]] += x[1]
    assert sum(loads.values()) == sum(r.length for r in rows)


@pytest.mark.parametrize("lengths", [[4], [100], [120], [127], [128], [1, 127], range(1, 128), [3, 200, 255], [1, 300, 5000, 4096, 2049]])
def test_what_waits_is_bounded_whatever_the_lengths(monkeypatch, lengths):
    monkeypatch.setattr(packing, "BUFFER", 1 << 13)
    r, packer, windows, rows = random.Random(3), packing.Packer(0), collections.Counter(), []
    docs = [r.choice(list(lengths)) for _ in range(4000)]
    for i, n in enumerate(docs):
        packer.add(i, bytes(4 * n))
        assert packer.waiting <= packing.BUFFER + max(lengths) and sum(n * len(s) for n, s in packer.stacks.items()) == packer.waiting == sum(packer.totals.values())
    packer.pack()
    assert packer.waiting < packing.LONGEST
    packer.close()
    rows = packer.drain()
    assert not packer.docs and not packer.held and not packer.mask
    got = collections.Counter()
    for doc, start, length, _, n, sequence, offset, window in rows:
        got[doc] += length
        windows[sequence, window] += length
        assert 0 <= start and start + length <= n == docs[doc] and offset + length <= window
    assert got == {i: n for i, n in enumerate(docs)} and all(n == window for (_, window), n in windows.items())


def test_few_documents_wait_however_short(monkeypatch):
    monkeypatch.setattr(packing, "DOCUMENTS", 500)
    packer = packing.Packer(0)
    for i in range(3000):
        packer.add(i, bytes(4))
        assert len(packer.docs) <= 500


def test_packing_short_documents_takes_linear_time():
    def took(n):
        packer, began = packing.Packer(0), time.process_time()
        for i in range(n):
            packer.add(i, bytes(16 + 4 * (i % 7)))
        packer.close()
        return time.process_time() - began

    took(1000)
    assert took(200_000) < 10 * took(40_000)


def test_step_groups_are_balanced(monkeypatch):
    monkeypatch.setattr(packing, "STEP_TOKENS", 1 << 15)
    r = random.Random(4)
    rows = [(None, 0, 0, 0, 0, sequence, 0, 1 << r.randint(0, 12)) for sequence in range(900)] * 2
    groups = packing.step_groups(rows, 7)
    loads = collections.Counter()
    for sequence, window, group in {(x[5], x[7], g) for x, g in zip(rows, groups, strict=True)}:
        loads[group] += window
    assert min(loads) == 7 and len(loads) > 10 and max(loads.values()) - min(loads.values()) <= 4096
    assert len({(x[5], g) for x, g in zip(rows, groups, strict=True)}) == 900


def test_word_tokenizer_equals_whole_texts():
    t, r = packing.WordTokenizer(WORD_MODEL), random.Random(2)
    parts = ["a", "The", "é", "e\u0301", "ß", "İ", "Σ", "ΑΣ", "'s", "don't", ".", ",", "!!", "12", "漢", " ", "  ", "\n", "\t", "\u00a0", "<|endoftext|>", "%$#", "x_y", "😀", "\u2028"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    for text, got in zip(texts, t.encode(pa.array(texts)), strict=True):
        assert got == np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)
    assert t.encode(pa.array([None, "", texts[0]], pa.string())[0:2]) == [b"", b""] and t.encode(pa.array(["x", *texts[:9]])[3:5]) == t.encode(pa.array(texts[2:4]))
    assert t.encode(pa.array([], pa.string())) == []


def test_memory_holds_what_is_asked_for_and_stays_small():
    memory, r = common.Memory(100), random.Random(11)
    for _ in range(300):
        keys = {r.randrange(1000) for _ in range(20)}
        missing = memory.missing(keys)  # may start a new generation
        memory.new.update((k, -k) for k in missing)
        assert all(memory.new[k] == -k for k in keys)
        assert len(memory.new) + len(memory.old) <= 100 + 2 * 20


def held_by_stages():
    return [
        (lambda df: minhash.features(df.withColumnRenamed("doc_id", "id"), 5, 80), minhash.Shingler),
        (secrets.redact_secrets, secrets.Scanner),
        (lambda df: packing.pack(df, WORD_MODEL), packing.Packer),
        (lambda df: toxicity.score(df.withColumnRenamed("doc_id", "id"), toxicity.Model()), toxicity.Scorer),
    ]


@pytest.mark.parametrize("stage", range(len(held_by_stages())))
def test_memory_is_given_back_when_what_a_task_held_is_gone(spark, monkeypatch, stage):
    """A worker lives on through later stages, so the last time must come after what its task remembered is gone."""
    make, kind = held_by_stages()[stage]
    df = spark.createDataFrame([(1, "a text of some words")], "doc_id long, text string")
    functions, alive = [], []

    def counted():
        gc.collect()
        alive.append(sum(isinstance(x, kind) for x in gc.get_objects()))

    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: functions.append(f) or self)
    make(df)
    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    for module in (common, arrow):
        monkeypatch.setattr(module, "release", counted)
    counted()
    (f,) = functions
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a text of some words", None])], ["id" if kind is not secrets.Scanner else "doc_id", "text"])
    assert sum(x.num_rows for x in f(iter([batch])))
    assert len(alive) > 1 and alive[-1] == alive[0]


def test_workers_need_little_memory_for_many_words():
    """The peaks of two workers and a full heap have to fit one executor together."""
    index, text = secrets.Scanner().index, b"a line of some words\n" * 400_000
    tracemalloc.start()
    index.postings([text])
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < len(text) + (48 << 20)
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(300_000)]
    tokenizer = packing.WordTokenizer(WORD_MODEL)
    for at in range(0, len(words), 30_000):
        some = " ".join(words[at : at + 30_000])
        (got,) = tokenizer.encode(pa.array([some]))
        assert at or got == np.array(tokenizer.tokenizer.encode(some, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert len(tokenizer.letters.new) + len(tokenizer.letters.old) <= (1 << 17) + 60_000


def test_batches_are_made_small(spark):
    common.in_small_batches(spark.range(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(common.BATCH_ROWS)


def brute_spans(text):
    kinds = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ]
    out = []
    for n, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_secrets_match_brute_force(spark):
    r = random.Random(3)
    parts = ['password="', "PassWd : ", "ſecret=", "secret=", "token", "=", "api_key:'", "APIKEY=", "abcdef0123", "0123456789abcdef" * 2, "AKIA", "ABCDEFGH12345678", "é", "😀", " ", "x", "-----BEGIN RSA PRIVATE KEY-----", "gh", "p_" + "a1B2" * 9]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(800)]
    got = {x.doc_id: x for x in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        spans = brute_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), repr(text)
        assert set(filter(None, spans.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_hex == spans.count("hex:") and got[i].n_assign == spans.count("assign:")


def test_more_kinds_and_redaction(spark):
    key = "ghp_" + "a1B2" * 9
    df = spark.createDataFrame([(1, f"é {key} end"), (2, None), (3, "clean")], "doc_id long, text string")
    assert f"github:2:{2 + len(key)}" in secrets.scan_secrets(df).where("doc_id = 1").first().spans
    assert {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()} == {1: "é [GITHUB] end", 2: None, 3: "clean"}


def test_trigram_queries_are_necessary_conditions():
    for rule in secrets.RULES:
        query = trigrams.trigram_query(rule.pattern)
        assert (query is True) == (rule.kind == "hex")
    q = trigrams.trigram_query(rb"(abcd|xy[pq]z)+e?fgh")
    for text, want in ((b"abcdefgh", True), (b"XYPZFGH", True), (b"abcd", False), (b"xyz fgh", False)):
        index = trigrams.TrigramIndex(trigrams.trigrams_of(q))
        assert bool(trigrams.candidates(q, index.postings([text]), 1)[0]) == want


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    counts = collections.Counter(windows)
    covered = {j for k, x in enumerate(windows) if counts[x] > 1 for j in range(k, k + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text or ""), lines, len(covered), failed


def test_quality_base_matches_brute_force(spark, labels):
    r = random.Random(4)
    docs = [(i, "".join(r.choice(["a ", "b ", "c\n", "a b c d e ", "#", "é ", "\u00a0", "\x0b", "x\r\n", "\x85"]) for _ in range(r.randint(0, 40)))) for i in range(400)]
    got = quality.judge_quality(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute_quality(docs[x.doc_id][1])
        assert not (x.base_failed and x.kept)


def brute_scores(docs, good):
    """doc_id -> mean log ratio, and the threshold, by dictionaries instead of arrays of buckets."""
    signed = lambda x: (x & (1 << 64) - 1).to_bytes(8, "little")
    one = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    small = lambda k: k.to_bytes(4, "little")
    place = lambda h: (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS

    def grams(text):
        h = [one(w.lower().encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return [place(one(small(1), one(signed(x)))) for x in h] + [place(one(signed(y), one(signed(x)))) for x, y in zip(h, h[1:])]

    found = {i: grams(t) for i, t in docs}
    half = {i: one(small(8), one(signed(i))) % 2 for i in good}
    raw, target = collections.Counter(g for x in found.values() for g in x), collections.Counter(g for i in good if not half[i] for g in found[i])
    of = lambda counts, g: (counts[g] + quality.SMOOTHING) / (sum(counts.values()) + quality.BUCKETS * quality.SMOOTHING)
    ratio = {g: np.log(of(target, g) / of(raw, g)) for g in raw}
    score = {i: float(np.mean([ratio[g] for g in x])) if x else 0.0 for i, x in found.items()}
    return score, float(np.percentile([score[i] for i in good if half[i]], 100 * quality.LOST))


@pytest.mark.parametrize("lost", [quality.LOST, 0.2])
def test_quality_scores_and_verdicts_match_brute_force(spark, monkeypatch, lost):
    monkeypatch.setattr(quality, "LOST", lost)
    r = random.Random(9)
    clean, noisy = [f"Word{k}" for k in range(60)] + ["é"], [f"x{k}" for k in range(60)]
    docs = [(i, None if i % 50 == 9 else " ".join(r.choice(noisy if r.random() < i % 7 / 7 else clean) for _ in range(r.randint(0, 40)))) for i in range(300)]
    good = [i for i in range(300) if i % 7 < 3 and i % 2]
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(0, 300)], "doc_id long, quality int")
    score, threshold = brute_scores(docs, good)
    got = quality.judge_quality(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    assert len(got) == 300 and {x.kept for x in got} == {True, False}
    for x in got:
        assert abs(x.score - score[x.doc_id]) < 1e-9
        if abs(x.score - threshold) > 1e-9:
            assert x.kept == (not x.base_failed and x.score > threshold)


def test_quality_tells_junk_from_prose(spark):
    r = random.Random(5)
    good, junk = [f"w{k}" for k in range(200)], [f"j{k}%%%" for k in range(200)]
    docs = [(i, " ".join(r.choice(junk if i % 4 == 0 else good) for _ in range(60))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 3)], "doc_id long, quality int")
    kept = {x.doc_id for x in quality.judge_quality(spark.createDataFrame(docs, "doc_id long, text string"), labels).where("kept").collect()}
    assert len(kept ^ {i for i in range(400) if i % 4}) <= 8


def test_quality_counts_every_trusted_document(spark, monkeypatch):
    n = 20_000
    marks = spark.range(n).select(F.col("id"), F.lit(1).alias("quality"))
    for most in (500_000, 10):  # sent to executors, or shuffled
        monkeypatch.setattr(quality, "BROADCAST_IDS", most, raising=False)
        trusted = quality.trusted_ids(marks.unionByName(marks).unionByName(spark.sql("select 1L id, 0 quality union all select 99999L, 0")))
        assert trusted.count() == trusted.select("id").distinct().count() == n
        target = trusted.where("half = 0")
        assert 0.45 * n < target.count() < 0.55 * n
        docs = spark.range(2 * n).select("id", F.when(F.col("id") < n, "good").otherwise("bad").alias("text"))
        got = quality.ratios(docs, target)
        good, bad = (spark.range(1).select(quality.buckets_of(F.array(F.lit(w)))[0]).first()[0] for w in ("good", "bad"))
        total, raw = target.count() + quality.BUCKETS, 2 * n + quality.BUCKETS
        assert abs(got[good] - (np.log((target.count() + 1) / total) - np.log((n + 1) / raw))) < 1e-9
        assert abs(got[bad] - (np.log(1 / total) - np.log((n + 1) / raw))) < 1e-9


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://Example.NET/en/a?b#c": ("example.net", "/en/a", "example.net/en/", "allow"),
        "http://example.net/EN/a": ("example.net", "/EN/a", "net/", "block"),
        "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "x://a.net": ("a.net", "", None, "allow"),
        "x://www.example.com/de/1": ("www.example.com", "/de/1", "example.com/de/", "block"),
        "x://a.org/fr/?q": ("a.org", "/fr/", "org/fr/", "allow"),
        "x://casino-win.example.org/en/": ("casino-win.example.org", "/en/", None, "block"),
        "x://a.org?x=net/": ("a.org", "", None, "allow"),
        "": ("", "", None, "allow"),
        "x://a.org/wp-login.php": ("a.org", "/wp-login.php", None, "block"),
        "x://a.org/fr/WP-Login.php": ("a.org", "/fr/WP-Login.php", "org/fr/", "allow"),
        "x://a.org/my-wp-login.php5": ("a.org", "/my-wp-login.php5", None, "allow"),
        "x://a.org/a/PHOTO.JPG?x#y": ("a.org", "/a/PHOTO.JPG", None, "block"),
        "x://a.org/jpg/a.html": ("a.org", "/jpg/a.html", None, "allow"),
        "x://a.org/p?a=1&Aff_ID=7": ("a.org", "/p", None, "block"),
        "x://a.org?aff_id=7": ("a.org", "", None, "block"),
        "x://a.org/p?b=aff_id#?aff_id=": ("a.org", "/p", None, "allow"),
        "x://a.org?.net/": ("a.org", "", None, "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_url_index_matches_all_rules_run_on_all_urls(spark):
    r = random.Random(11)
    parts = [*r.sample(urls.LABELS, 8), *r.sample(urls.SEGMENTS, 8), *r.sample(urls.SUFFIXES, 5), *r.sample(urls.KEYS, 8), "org", "net", "com", "example", "en", "de", "fr", "a", "é", "10"]
    cased = lambda x: x.upper() if r.random() < 0.1 else x
    some = lambda: "".join(cased(r.choice(parts)) + r.choice("//..??&==-#_") for _ in range(r.randint(0, 7)))
    cases = [f"http://{some()}" for _ in range(3000)] + ["http://" + "ads/" * 20_000 + "x.jpg", "http://" + "a" * 300_000 + "?sid=1"]
    rules = (*urls.RULES, urls.Rule(r"[0-9]\.[0-9]", (), "block"))
    assert 150 < len(rules) < urls.MOST_RULES
    lowered = str.maketrans(urls.UPPER, urls.LOWER)

    def brute(url):
        rest = url[7:]
        host = re.match(r"[^/?#]*", rest)[0]
        place = host.translate(lowered) + rest[len(host) :].split("#")[0]
        fits = [x for x in rules if re.search(x.pattern.replace(r"\z", r"\Z"), place if x.name else place.translate(lowered))]
        named = max((x for x in fits if x.name), key=lambda x: len(x.name), default=None)
        return (named.name, named.verdict) if named else (None, "block" if fits else "allow")

    got = {x.page_id: (x.rule, x.verdict) for x in urls.filter_urls(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string"), rules=rules).collect()}
    want = {i: brute(x) for i, x in enumerate(cases)}
    assert got == want and len(set(want.values())) >= 4
    only = urls.filter_urls(spark.createDataFrame([(1, "x://a/1.2"), (2, "x://a/")], "page_id long, url string"), rules=rules[-1:])
    assert {x.page_id: x.verdict for x in only.collect()} == {1: "block", 2: "allow"}


def test_url_cost_does_not_grow_with_the_rules(spark):
    """URLs that fetch no rule, past 100 and past 9,000 of them."""
    df = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.some-site.example/path/of/segments/"), F.col("id")).alias("url")).persist()
    df.count()
    plans = {n: urls.filter_urls(df, rules=tuple(urls.blocking(urls.LABEL, f"label{k}x") for k in range(n))) for n in (100, 9000)}
    took = dict.fromkeys(plans, 1e9)
    for _ in range(4):
        for n, plan in plans.items():
            began = time.time()
            plan.write.format("noop").mode("overwrite").save()
            took[n] = min(took[n], time.time() - began)
    df.unpersist()
    assert took[9000] < 2 * took[100] + 0.5


PAGE = """<html><head><title>x</title><style>p{}</style></head><body class="post"><header><a href=/>Home</a> Site</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to do a lot of things here and there for you all the time, ok?</div><main><h1>Title</h1><p>First &amp; second<br>line. <a href="/x">link</a> more   text.
<div class="ad">Buy now <a>this</a></div><p>Short.<form><label>Name</label><input></form><aside>Related</aside><section id="comments"><h2>Comments</h2><p>I think this is a great article and it has many many words in it yes.</p></section></main>
<footer>&copy; 2020</footer><script>var a="</p>";"""


def test_main_text():
    assert html.main_text(PAGE) == "Title\nFirst & second line. link more text.\nShort."
    assert html.main_text("") == "" and html.main_text("<!-- open") == "" and html.main_text("<script>x") == ""
    assert html.main_text("<article><p>" + "a < b & c " * 3) == "a < b & c a < b & c a < b & c"
    assert html.main_text("<article>" + "<b>" * 20000 + "deep") == "deep"


def path_of(tree, row):
    """(features that decide, verdict) of a block, by the tree's definition."""
    names = []
    while not isinstance(tree, int):
        feature, limit, low, high = tree
        names.append(html.FEATURES[feature])
        tree = low if row[feature] <= limit else high
    return names, tree


def test_the_tree_is_grown_on_the_table_by_brute_force():
    """Each split lowers the Gini impurity most, by the features' weights, each leaf is pure, and every labelled block gets its label."""
    rows = html.labelled()
    impurity = lambda some: len(some) * 2 * (q := sum(r[-1] for r in some) / len(some)) * (1 - q) if some else 0

    def check(tree, some):
        if isinstance(tree, int):
            assert {r[-1] for r in some} == {tree}
            return
        feature, limit, low, high = tree
        gains = {(k, (x + y) / 2): html.TRUST[k] * (impurity(some) - impurity([r for r in some if r[k] <= (x + y) / 2]) - impurity([r for r in some if r[k] > (x + y) / 2])) for k in range(len(html.FEATURES)) for v in [sorted({r[k] for r in some})] for x, y in zip(v, v[1:])}
        assert gains[feature, limit] >= max(gains.values()) - 1e-9
        check(low, [r for r in some if r[feature] <= limit])
        check(high, [r for r in some if r[feature] > limit])

    check(html.TREE, rows)
    assert all(path_of(html.TREE, r)[1] == r[-1] for r in rows) and len(rows) > 100


def test_words_and_links_decide():
    """On whole pages, for a part of the blocks; and against the marks where these say little."""
    pages = [r for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    used = [path_of(html.TREE, row)[0] for (page,) in pages for row in html.features(html.blocks_of(page or ""))]
    assert sum({"words", "links"} <= set(names) for names in used) > 0.3 * len(used)
    text = " ".join(["word"] * 300)
    line = "a sentence of a dozen words or more that says what the matter is"
    for page, want in (
        (f"<article><p>{text}</p><ol class=references><li><a href=1>Smith 1999</a><li><a href=2>Jones 2001</a></ol></article>", f"{text}\nSmith 1999\nJones 2001"),
        (f"<article><p>{text}</p><p class=alert>{line}</p><p>End.</p></article>", f"{text}\n{line}\nEnd."),
        (f"<article><p>{text}</p><p class=ad>Buy two now</p><p>End.</p></article>", f"{text}\nEnd."),
        (f"<article><p>{text}</p><p class=related><a href=x>{line}</a></p></article>", text),
        (f"<main><p class=social>{line}</p></main>", line),
        (f"<body><form action=/><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{text}</p></article><input></form></body>", f"Title\n{text}"),
        (f"<article><p>{text}</p><form><label>Your name</label><p>{line}</p></form></article>", text),
        (f"<article><p>{text}</p><div class=comments><p>{line}</p></div></article>", text),
        (f"<div><a href=1>One</a></div><div>{text}</div><div>Two words</div><div>{text}</div><div><a href=2>Two</a></div><div>Three</div>", f"{text}\nTwo words\n{text}"),
        (f"<article><h2>Two words</h2><p>{text}</p></article>", f"Two words\n{text}"),
    ):
        assert html.main_text(page) == want, page
    assert html.main_text(f"<article><h2>One title</h2><p>some <a>linked text</a></p><p>{text}</p><p>The end.</p></article>").count("\n") == 3
    assert html.main_text(f"<div><p>{text}</p><p>{'more ' * 20}</p></div>").startswith(text)


def test_every_article_block_of_whole_pages_survives(spark):
    for page in [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]:
        blocks = html.blocks_of(page or "")
        assert all(b.text in html.main_text(page).split("\n") for b in blocks if b.article and not b.furniture)
        assert not any(html.classify(html.TREE, x) for b, x in zip(blocks, html.features(blocks), strict=True) if b.furniture)


def test_class_names_and_broken_elements():
    text = " ".join(["word"] * 60)
    for page, want in (
        (f'<div class="content has-sidebar"><h1>T</h1><p>{text}</p></div>', f"T\n{text}"),
        (f'<article class="post comments-open"><p>{text}</p></article>', text),
        ("<main><p>a b c</p><div class='post-comments'><p>bad</p></div><div class=comment>bad</div></main>", "a b c"),
        ('<div class="site no-sidebar"><div class="site-header">bad</div><div class="main"><p>good</p></div><div class="widget-area"><p>bad</p></div></div>', "good"),
        ("<datalist><option value=a></datalist><article><p>Hello there.</p></article>", "Hello there."),
        ("<article><select><option>a<option>b</select><p>yes</p><svg><p>also</p></article>", "yes\nalso"),
        ("<article><p>one <math><mi>x</mi><mo>=</mo><mn>1</mn></math> two</p><object data=x><p>fall back</p></object></article>", "one x=1 two\nfall back"),
        ("<body><a href=x><div>menu</div></a><a href=y><div>menu two</div></a><article><p>Text here.</p></article>", "Text here."),
        ("<article><p><a href=x>A link that is never closed<p>more text<div>still</div></article>", "A link that is never closed\nmore text\nstill"),
        ("<article><h2><a href=x>Linked title</a></h2><p>Short.</p><p><a href=y>See more</a></p><p>End.</p></article>", "Linked title\nShort.\nSee more\nEnd."),
        ("<article><p>x</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>", "x\nOne\nTwo"),
        ("<body><h1>Title</h1><p>Short text.</p><p>Another.</p><div>Copyright</div></body>", "Title\nShort text.\nAnother."),
    ):
        assert html.main_text(page) == want, page


def test_generated_layouts():
    """Pages of which each block is known to be the article's or not."""
    r = random.Random(21)
    words = lambda n: " ".join(r.choice("alpha beta gamma delta &amp; &eacute;t&eacute; x&lt;y".split()) for _ in range(n))
    plain = lambda t: " ".join(t.replace("&lt;", "<").replace("&eacute;", "\u00e9").replace("&amp;", "&").split())
    furniture = [
        "<nav><ul><li><a href=/a>{}</a><li><a href=/b>Two</a></ul></nav>", "<aside><p>{}</p></aside>", "<footer><div>{}</div></footer>", '<div class="ad-banner">{}</div>', "<div id='cookie-notice'><p>{}</p></div>",
        "<form><label>{}</label><input><button>Go</button></form>", "<script>var x = '<p>{}</p>';</script>", "<style>p:after {{ content: '{}' }}</style>", "<section class='comments'><h3>Comments</h3><p>{}</p></section>",
        "<div role=navigation>{}</div>", "<div hidden>{}</div>", "<!-- <p>{}</p> -->", "<div class=sidebar><div><p>{}</p></div></div>", "<div class='share buttons'>{}</div>", "<select><option>{}</select>", "<div style='display: none'>{}</div>",
    ]
    opened = [("<article>", "</article>"), ("<main id=main>", "</main>"), ("<div class='entry-content'>", "</div>"), ("<div id=content class='has-sidebar wide'>", "</div>"), ("<article class='post has-comments'><div>", "</div></article>")]
    for _ in range(400):
        first, last = r.choice(opened)
        page, want = ["<!DOCTYPE html><html><head><title>T</title></head><body class='with-menu'><header>Site name</header>"], []
        page += [r.choice(furniture).format(words(r.choice([1, 5, 40]))) for _ in range(r.randint(0, 3))] + [first]
        for _ in range(r.randint(1, 8)):
            if r.random() < 0.3:
                page.append(r.choice(furniture).format(words(r.choice([1, 5, 40]))))
                continue
            t = words(r.choice([1, 2, 3, 8, 20, 90]))
            want.append(plain(t))
            page.append(r.choice(["<p>{}</p>", "<h2>{}</h2>", "<p>{}", "<div><b>{}</b></div>", "<ul><li>{}</ul>", "<table><tr><td>{}</table>", "<blockquote>{}</blockquote>", "<pre> {}\n</pre>"]).format(t.replace(" ", r.choice([" ", "\n", "\t "]), 1)))
        page += [last] + [r.choice(furniture).format(words(r.choice([1, 5, 40]))) for _ in range(r.randint(0, 3))]
        page = r.choice(["", "\n"]).join(page) + "</body></html>"
        assert html.main_text(page) == "\n".join(want), page


def test_very_long_pages():
    text = " ".join(["word"] * 400_000)
    assert html.main_text(f"<article><p>{text}</p>{'<p>a</p>' * 50_000}</article>").count("\n") == 50_000
    began = time.process_time()
    assert html.main_text("<svg>" * 30_000 + "<p>x</p>") == "x" and html.main_text("<article>a < b" + "<a " * 100_000) == "a < b"
    assert html.main_text("<article>x" + "<!-- " * 100_000 + "> y") == "x" and html.main_text("<article>" + "<a title='" * 100_000 + "> y") == "y"
    assert time.process_time() - began < 5


def test_languages_are_told_apart(spark):
    r = random.Random(6)
    words = {"aa": ["the", "and", "house", "with", "thing"], "bb": ["der", "und", "haus", "mit", "ding", "für"], "cc": ["ñor", "casa", "llama", "que", "año"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(r.choices(list(words), k=300))]
    out = langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r_.lang_pred == rows[r_.doc_id][2] and 0 <= r_.score <= 1 for r_ in out)
    assert {r_.doc_id for r_ in out if r_.held_out} == {i for i in range(300) if crc32(str(i).encode()) % 4 == 2}


def test_hyperdimensional_parts_are_counted_as_a_whole():
    e = langid.Encoder()
    text = "Ärger mit   Zahlen 12 und Straße " * 50
    whole = dict(zip(*(x.tolist() for x in e.counts(text)), strict=True))
    part, langid.PART = langid.PART, 97
    try:
        codes, counts = e.counts(text)
    finally:
        langid.PART = part
    assert sum(counts) == sum(whole.values())


def test_undetermined_texts(spark):
    rows = [(1, "1234 !!", "en"), (2, None, "en"), (3, "hello there", "en")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == ("und", 0.0) and got[2] == ("und", 0.0)


def test_letters_of_all_planes_are_letters(spark):
    numbers = langid.letter_numbers()
    assert all((numbers[c] > 0) == chr(c).isalpha() for c in range(0x110000))
    rows = [(1, "\U00030000\U00030001 \U00031350", "en"), (3, "hello there", "en")]
    got = {r.doc_id: r for r in langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1].lang_pred == "en" and got[1].score > 0


def brute_segments(scores):
    """Ruzzo and Tompa's definition, by recursion on the best segment."""

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-12 or (abs(total - best[2]) <= 1e-12 and (j - i) < best[1] - 1 - best[0])):
                    best = (i, j + 1, total)
        return [] if best is None else split(a, best[0]) + [best] + split(best[1], b)

    return split(0, len(scores))


def test_segments_match_the_definition():
    r = random.Random(7)
    for _ in range(300):
        s = [r.choice([0, 0, 0, 1.0, 2.5]) for _ in range(r.randint(0, 25))]
        got = toxicity.segments(np.array(s))
        want = brute_segments([x if x > 0 else -toxicity.DRIFT for x in s])
        assert [(a, b, round(x, 6)) for a, b, x in got] == [(a, b, round(x, 6)) for a, b, x in want]


def test_segments_take_linear_time():
    for hit in (0.3, 40.0):
        scores = np.zeros(400_000)
        scores[::4] = hit
        began = time.process_time()
        found = toxicity.segments(scores)
        assert time.process_time() - began < 5
        assert len(found) == (100_000 if hit < 1 else 1)


@pytest.mark.parametrize(("n", "toxic_in", "of"), [(600, 1, 5), (600, 1, 2), (600, 1, 9), (600, 8, 9), (11_000, 1, 2)])
def test_toxic_documents_are_found(spark, n, toxic_in, of):
    """Whatever the classes' sizes, above the sample's bound too."""
    r = random.Random(8)
    words, bad = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], ["nasty", "awful", "grumph"]
    is_toxic = [i % of < toxic_in for i in range(n)]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        if is_toxic[i]:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(bad) + r.choice(["", "er", "ish"]))
        rows.append((i, " ".join(text)))
    if n > 10_000:
        assert min(sum(is_toxic), n - sum(is_toxic)) > 1.2 * toxicity.PER_CLASS
    marks = [(i, int(x)) for i, x in enumerate(is_toxic)]
    out = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    held = [x for x in out if x.held_out]
    assert {x.doc_id for x in held} == {i for i in range(n) if crc32(str(i).encode()) % 5 == 0}
    assert sum(x.predicted == is_toxic[x.doc_id] for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and (x.score >= 0.5) == bool(x.predicted) for x in out)
    assert any(x.n_passages for x in out if x.predicted)


def test_toxicity_model_and_scores_match_brute_force(spark):
    """Counts, log-odds, the calibration's rate, the curve and each document's score, on a whole table."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.plain(docs)
    named = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    sample = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.training_ids(named).collect():
        assert crc32(str(r.id).encode()) % 5
        if texts.get(r.id) is not None:
            old = sample.get(texts[r.id], (0, 9, 0))
            sample[texts[r.id]] = (max(old[0], r.toxic), min(old[1], r.fold), old[2] + r.weight)
    words = lambda x: re.findall(r"[^\W\d_]+", x)
    ends = lambda w: [w.lower(), *(w.lower()[:k] + "-" for k in (3, 4, 5, 6) if k < len(w.lower()))]

    def lexicon(folds):
        count = {1: collections.Counter(), 0: collections.Counter()}
        for text, (y, fold, _) in sample.items():
            if fold in folds:
                count[y].update({t for w in words(text) for t in ends(w)})
        toxic, other = (sum(count[y].values()) for y in (1, 0))
        weight, out = 0.25 * min(toxic, other), {}
        for t, n in count[1].items():
            m = count[0][t]
            prior = weight * (n + m) / (toxic + other)
            odds = np.log((n + prior) / (toxic + weight - n - prior)) - np.log((m + prior) / (other + weight - m - prior))
            if odds >= np.log(2) and odds / np.sqrt(1 / (n + prior) + 1 / (m + prior)) >= 3:
                out[t] = odds
        return out

    model = toxicity.fit(rows, named)
    whole = lexicon(range(5))
    assert model.lexicon.keys() == whole.keys() and len(whole) > 5 and all(abs(model.lexicon[t] - x) < 1e-9 for t, x in whole.items())
    without = [lexicon([k for k in range(5) if k != fold]) for fold in range(5)]
    score_of = lambda x, lex: [max([lex.get(t, 0.0) for t in ends(w)]) for w in words(x)]
    background = [s for text, (y, fold, _) in sample.items() if not y for s in score_of(text, without[fold])]
    share = max(1e-5, sum(s > 0 for s in background) / len(background))
    positive = collections.Counter(round(s, 1) for s in background if s > 0) or collections.Counter({np.log(2): 1})
    share = min(share, 0.5 * 0.25 / (0.25 + max(positive)))
    mean = sum(n * np.exp(model.scale * s) for s, n in positive.items()) / sum(positive.values())
    assert abs((1 - share) * np.exp(-0.25 * model.scale) + share * mean - 1) < 1e-6

    evidence = lambda x: sum(max(0.0, model.scale * s - np.log(len(x) + 1)) for *_, s in toxicity.segments(np.array(x)))
    x = np.array([np.log1p(evidence(score_of(t, without[fold]))) for t, (_, fold, _) in sample.items()])
    y, weight = (np.array([v[k] for v in sample.values()], dtype=float) for k in (0, 2))
    weight *= len(weight) / weight.sum()
    top = max(1.0, x.max())
    p = 1 / (1 + np.exp(-(model.intercept + model.slope * x)))
    w = np.array([model.intercept, model.slope * top])
    assert np.abs(np.array([(weight * (p - y)).sum(), (weight * (p - y) * x / top).sum()]) + 1e-3 * w).max() < 1e-4
    for r in toxicity.score_toxicity(docs, labels).collect():
        z = model.intercept + model.slope * np.log1p(evidence(score_of(texts[r.doc_id] or "", whole)))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_does_not_depend_on_the_order_of_equal_texts(spark):
    r = random.Random(11)
    rows = [(i, " ".join(r.choice("red blue green nasty".split() if i % 3 else "red blue green".split()) for _ in range(12)), int(i % 3 > 0)) for i in range(240)]
    rows += [(1000 + i, rows[i % 7][1], i % 2) for i in range(60)]
    found = []
    for some in (rows, rows[::-1], r.sample(rows, len(rows))):
        df = spark.createDataFrame(some, "doc_id long, text string, toxic int")
        found.append({x.doc_id: round(x.score, 9) for x in toxicity.score_toxicity(df, df).collect()})
    assert found[0] == found[1] == found[2]


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece as library

    model, r = library.SentencePieceProcessor(model_file=PIECE_MODEL), random.Random(9)
    parts = ["a", "e", "th", "in", "er", " ", "  ", ".", ",", "ing", "0", "é", "ß", "\n", "漢", "😀", "tion", "A", "▁", "\t", "$", "###", "the", "    "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    bpe = sentencepiece.model_of(PIECE_MODEL)
    for t in texts:
        ids = np.array(model.encode(t), dtype="<u4").tobytes()
        assert bpe.encode(t) == ids and bpe.decode(ids) == model.decode(model.encode(t)), repr(t)


def test_chunks_equal_whole_texts():
    bpe, r = sentencepiece.model_of(PIECE_MODEL), random.Random(10)
    parts = ["a", "e", "th", "in", "er", "ing", "é", "漢", "▁", "▁▁▁", "tion", "."]
    for k in range(300):
        text = "▁" + "".join(r.choice(parts[: 6 if k % 2 else 12]) for _ in range(r.randint(20, 120)))
        for size in (16, 23, 64):
            side, chunks = bpe.longest - 1, []
            for at in range(0, len(text), size):
                end, low = min(len(text), at + size), max(0, at - side)
                chunks.append((text[low : end + side], at - low, end - low))
            matrices = [bpe.transfer(*c) for c in chunks]
            states = sentencepiece.boundary_states(matrices)
            got = b"".join(bpe.traced(*c, x, y) for c, x, y in zip(chunks, states, states[1:], strict=False))
            assert got == bpe.encode_words(text)
    a, b, c = matrices[:3]
    assert sentencepiece.product(sentencepiece.product(a, b), c) == sentencepiece.product(a, sentencepiece.product(b, c))


def test_states_by_levels_equal_states_by_prefixes():
    """The associative scan against the best path by dynamic programming, for any number of matrices."""
    r, start = random.Random(6), (0, sentencepiece.ANY)
    for n in range(1, 14):
        bounds = [[start], *([(0, k) for k in range(r.randint(1, 4))] for _ in range(n - 1)), [start]]
        matrices = [{(a, b): float(r.randrange(1000)) for a in x for b in y} for x, y in zip(bounds, bounds[1:])]
        best = {start: (0.0, [start])}
        for m in matrices:
            best = {y: max((best[x][0] + w, [*best[x][1], y]) for (x, z), w in m.items() if z == y and x in best) for y in {b for _, b in m}}
        assert sentencepiece.boundary_states(matrices) == best[start][1] or sum(m[s] for m, s in zip(matrices, zip(*(lambda q: (q, q[1:]))(sentencepiece.boundary_states(matrices))))) == best[start][0]


def test_long_words_are_not_remembered():
    bpe = sentencepiece.model_of(PIECE_MODEL)
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefgh", k=20_000)) for _ in range(5)]
    library = __import__("sentencepiece").SentencePieceProcessor(model_file=PIECE_MODEL)
    for t in [*texts, "short " + texts[0] + " words"]:
        assert np.frombuffer(bpe.encode(t), dtype="<u4").tolist() == library.encode(t)
    assert max(map(len, bpe.known)) <= sentencepiece.SHORT


def test_giant_documents_take_the_chunked_way(spark, monkeypatch):
    texts = ["x" * 70_000, "word and other " * 6000, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bpe = sentencepiece.model_of(PIECE_MODEL)
    got = {r.id: bytes(r.ids) for r in sentencepiece.encode(df.select(F.col("doc_id").alias("id"), "text"), PIECE_MODEL).collect()}
    assert got == {i: bpe.encode(t) for i, t in enumerate(texts)}
