"""Cross-tokenizer alignment against brute force over whole texts."""

import collections
import hashlib
import random

import numpy as np
import pytest

from symdiff.llm import alignment

public = pytest.importorskip("public_tokenizers")
A_PATH, B_PATH = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    return a, b, decoders.ByteLevel()


def groups_of(text, models):
    """[(ids of A, ids of B)] or None."""
    a, b, decoder = models
    if not text:
        return None
    want, a_ids, b_ids = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    reverse = alignment.byte_alphabet()
    a_bytes = [bytes(reverse[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return None
    out, i, j = [], 0, 0
    while i < len(a_ids):
        p, q, x, y = i + 1, j + 1, len(a_bytes[i]), len(b_bytes[j])
        while x != y:
            if x < y:
                x, p = x + len(a_bytes[p]), p + 1
            else:
                y, q = y + len(b_bytes[q]), q + 1
        out.append((a_ids[i:p], b_ids[j:q]))
        i, j = p, q
    return out


def brute_force(rows, models):
    found = [(i, groups_of(t, models)) for i, t in rows]
    counts = collections.Counter((g[0][-1], g[1][-1]) for _, groups in found for g in groups or ())
    highest = collections.defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, groups in found:
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in groups]
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, slice string")
    got = alignment.align_documents(df, A_PATH, B_PATH)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


EDGES = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "  two  spaces  ", "three   spaces\n\n\tand a tab", "x▁y", "▁", "<|endoftext|> and <s></s><unk><0x0A>", "naïve café ÀÉ", "漢字 かな 한국어 ไทย",
    "😀 👩‍👩‍👧 é", "don't we'll I'M 1234567 3.14", "a\x00b\x1c c\x85d\xa0e f　g", "Ａ ﬁ ²", "word " * 5000, "unbroken" * 4000, "the cat the cat the cat", "the cat the cat the cat", "▁ after", "line one\nline two\r\nline  three ", "\ttab", "end\t", "﻿bom ﻿ x", "\x1c\x1d \x1e",
]


def test_edges(spark, models):
    rows = [*enumerate(EDGES), (None, "no id"), (None, None), (3, "an id again")]
    assert run(spark, rows) == brute_force(rows, models)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == brute_force([(1, None)], models)


def test_whole_documents_in_many_slices(spark, models, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 1 << 14)
    monkeypatch.setattr(alignment, "LOT", 3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()]
    assert run(spark, rows) == brute_force(rows, models)


def test_random_texts(models):
    """Whatever stands around them, stretches are cut as in the whole text."""
    rng = random.Random(1)
    aligner = alignment.Aligner(A_PATH, B_PATH)
    parts = [" ", " ", " ", "  ", "\n", "\t", "a", "the", "ing", "'s", "'ll", "é", "漢", "12", "!?", " ", "\x1c", "Ab", "<s>", "😀", "\r\n", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    numbers, known = aligner.slice(texts)
    for t, n in zip(texts, numbers, strict=True):
        want = groups_of(t, models)
        assert (n is None) == (want is None)
        if want is not None:
            assert ";".join(known.texts[i].decode() for i in n) == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want)
            assert alignment.of_links(n, known).tolist() == [b[-1] << 32 | a[-1] for a, b in want]


def test_dense_matrices_count_every_pair():
    rng = np.random.default_rng(1)
    b, a = rng.integers(1024, 2048, 5000), rng.integers(0, 60, 5000)
    pairs, first = np.unique(b << 32 | a, return_index=True)
    n = rng.integers(1, 4, len(first))
    got, counts, best = alignment.best_of(1, b[first].astype(np.int32), a[first].astype(np.int32), n)
    want = dict(zip(pairs.tolist(), n.tolist(), strict=True))
    assert dict(zip(got.tolist(), counts.tolist(), strict=True)) == want
    top = collections.defaultdict(int)
    for p, k in want.items():
        top[p >> 32] = max(top[p >> 32], k)
    assert best.tolist() == [want[p] == top[p >> 32] for p in got.tolist()]


def test_many_repeats_in_one_document():
    """Counts above 254 go into a list of their own."""
    rows = list(alignment.slice_rows(0, [7], ["the cat " * 300 + "the"], alignment.aligner_of(A_PATH, B_PATH)))
    total = sum(alignment.unpacked(dict(zip(alignment.LINKS.names, r, strict=True)))[2].sum() for r in rows[1:])
    assert rows[0][5] == [601] and total == 601


def test_table_of_pairs_and_groups(spark, models):
    df = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, "the cat ran")], "doc_id long, text string")
    got = {(r.b, r.a): (r.n, r.best) for r in alignment.token_table(df, A_PATH, B_PATH).collect()}
    counts = collections.Counter((g[1][-1], g[0][-1]) for t in ("the cat sat", "the cat ran") for g in groups_of(t, models))
    assert {k: n for k, (n, _) in got.items()} == counts
    said = {r.doc_id: r.groups for r in alignment.aligned_groups(df, A_PATH, B_PATH).collect()}
    assert said[2] == "" and said[1] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups_of("the cat sat", models))
