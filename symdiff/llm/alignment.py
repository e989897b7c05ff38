"""Cross-tokenizer alignment with id-striped dense count matrices.

Two tokenizers cut the same bytes: A a byte-level BPE over space + text, B a SentencePiece BPE that adds the space itself.
Offsets where tokens of both end cut a text into groups; the last tokens of a group's two sides are linked. A pair's
count is the number of its links in the whole corpus.

1. Texts are read in slices of about SLICE bytes. At a space between two characters that aren't white space, both tokenizers cut and
   neither looks across, so each distinct stretch between such spaces is encoded and grouped once and remembered by the
   task. A slice gives a row with its documents' numbers and digests, and a row for each stripe: the links whose B id
   lies in the stripe, as runs of equal pairs with the documents that hold them, two to three bytes a document and pair.
2. Counts: the slices' sums by pair are added up before and after one shuffle, then stripes of B ids are worked on by themselves: np.add.at fills
   a dense matrix of BLOCK B ids by all A ids, whose row maxima give the best counts. Only pairs that occur leave it.
3. Scoring is co-partitioned: links of a stripe meet its counts, in lots of LOT slices, so that no stripe's links are in one
   task. Each slice gets its documents' sums back from each stripe.

So memory follows a slice, a lot or a block, none of which grows with the corpus. A document's text is held whole.

Defined results: texts that are null, empty, or whose joined token bytes differ from space + text (as with U+2581, which B
takes for a space) have no tokens: zeros and an empty digest; repeated rows, and rows with a null id, are each aligned and counted; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.llm.common import Memory, in_small_batches, slices, written

#: Bytes of text in a slice, and its documents at most (their numbers have two bytes).
SLICE, DOCUMENTS = 1 << 22, 1 << 16
#: B ids in a stripe, and in one dense matrix.
STRIPE, BLOCK = 1 << 10, 1 << 6
#: Slices whose links of one stripe meet its counts together.
LOT = 64
#: Stretches that a task remembers, and their length at most.
CACHE, SHORT = 1 << 19, 48
#: Characters that are encoded in one call.
CALL = 1 << 16
SPACE = "▁"
#: The space that is cut out stands between two characters that aren't white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Where a space isn't cut out: two white space characters side by side, one of them a space.
BESIDE = [p for c in map(chr, range(0x3001)) if c.isspace() for p in {c + " ", " " + c}]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Stretches:
    """Groups of all distinct stretches of a slice: stretch k has n[k] = (tokens of A, of B, groups), its groups as text
    and its links as B id << 32 | A id."""

    def __init__(self, found: list[tuple[int, int, int, bytes, bytes]]):
        columns = list(zip(*found, strict=True)) or [()] * 5
        self.n = np.array(columns[:3], dtype=np.int64).T
        self.texts = columns[3]
        self.links = np.frombuffer(b"".join(columns[4]), dtype="<u8")
        self.starts = np.concatenate([[0], np.cumsum(self.n[:, 2])])


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = {i: bytes(alphabet[c] for c in t) if t not in special else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        #: Whether a space is a sure cut: no piece goes on behind a space that follows something else.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, dtype=np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        #: Ids as text, with what follows within a group and at the end of its side.
        self.a_texts, self.b_texts = ([np.array([f"{i}{end}" for i in range(len(sizes))], dtype=object) for end in ends] for sizes, ends in ((self.a_sizes, ",|"), (self.b_sizes, ",;")))
        self.known = Memory(CACHE)

    def stretches(self, text: str, beside: list[str] = BESIDE) -> list[str]:
        """What stands between sure cuts; each stretch has a space before it that isn't part of it. beside: what of BESIDE
        the text may hold."""
        if not self.cuts:
            return [text]
        if text[0] == " " or text[-1] == " " or any(p in text for p in beside):
            return CUT.split(text)
        return text.split(" ")

    def encode(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]] | None:
        """(ids of A, ids of B, the end of each stretch in bytes) of stretches in a row; None if the bytes aren't theirs."""
        whole = " " + " ".join(some)
        data = whole.encode()
        a = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        b = self.b.encode(whole[1:], num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.cumsum([len(x.encode()) + 1 for x in some]).tolist()

    def aligned(self, some: list[str]) -> list[tuple[int, int, int, bytes, bytes] | None]:
        """(tokens of A, of B, groups, groups as text, links) of each stretch; None for one whose bytes don't come back."""
        got = self.encode(some)
        if got is None:
            return [None] if len(some) == 1 else [self.aligned([x])[0] for x in some]
        a, b, ends = got
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        cuts, a_last, b_last = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        at = np.searchsorted(cuts, ends, "right")  # groups up to the end of each stretch
        if not np.array_equal(cuts[at - 1], ends):
            raise ValueError("a token crosses a space that was thought a sure cut")
        links = (b[b_last] << 32 | a[a_last]).astype("<u8")
        texts = []
        for ids, last, (within, at_end) in ((a, a_last, self.a_texts), (b, b_last, self.b_texts)):
            texts.append(within[ids])
            texts[-1][last] = at_end[ids[last]]
        # Tokens by group, A's before B's.
        group_of = [np.searchsorted(cuts, x) for x in (a_ends, b_ends)]
        order = np.argsort(np.concatenate([2 * group_of[0], 2 * group_of[1] + 1]), kind="stable")
        tokens = np.concatenate(texts)[order].tolist()
        a_at, b_at = (np.searchsorted(x, ends, "right").tolist() for x in (a_ends, b_ends))
        out, i, j, g = [], 0, 0, 0
        for p, q, h in zip(a_at, b_at, at.tolist(), strict=True):
            out.append((p - i, q - j, h - g, "".join(tokens[i + j : p + q])[:-1].encode(), links[g:h].tobytes()))
            i, j, g = p, q, h
        return out

    def learn(self, stretches: list[str]) -> dict[str, tuple | None]:
        """By many in a call; those with white space at an end, next to which a space is no sure cut, by themselves."""
        alone = [x for x in stretches if x[0].isspace() or x[-1].isspace()]
        out, at = {x: self.aligned([x])[0] for x in alone}, 0
        stretches = [x for x in stretches if x not in out]
        while at < len(stretches):
            size, end = 0, at
            while end < len(stretches) and (end == at or size + len(stretches[end]) < CALL):
                size += len(stretches[end])
                end += 1
            out.update(zip(stretches[at:end], self.aligned(stretches[at:end]), strict=True))
            at = end
        return out

    def slice(self, texts: list[str]) -> tuple[list[np.ndarray | None], Stretches]:
        """Each text as the numbers of its stretches, None if it has no tokens."""
        whole = "\n".join(texts)
        beside = [p for p in BESIDE if p in whole]
        split = [self.stretches(t, beside) if t and SPACE not in t else None for t in texts]
        distinct = set().union(*filter(None, split))
        short = {x for x in distinct if len(x) <= SHORT}
        learned = self.learn(list(self.known.missing(short)))
        self.known.new.update(learned)
        names = [*short, *(long := self.learn(list(distinct - short)))]
        found = [*map(self.known.new.__getitem__, short), *long.values()]
        number = dict(zip(names, range(len(names)), strict=True))
        if None in found:
            number.update((x, -1) for x, got in zip(names, found, strict=True) if got is None)
            found = [got or (0, 0, 0, b"", b"") for got in found]
        numbers = [np.fromiter(map(number.__getitem__, s), dtype=np.int64, count=len(s)) if s else None for s in split]
        return [None if n is None or (n < 0).any() else n for n in numbers], Stretches(found)


@lru_cache(maxsize=1)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def of_links(numbers: np.ndarray, known: Stretches) -> np.ndarray:
    """The links of stretches in a row."""
    n = known.n[numbers, 2]
    ends = np.cumsum(n)
    return known.links[np.repeat(known.starts[numbers] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


DOCS = ["doc_id", "n_a", "n_b", "n_groups"]
LINKS = pa.schema([("slice", pa.int64()), ("stripe", pa.int32()), *((c, pa.list_(pa.int64())) for c in DOCS), ("digest", pa.list_(pa.string())), *((c, pa.binary()) for c in ("pairs", "runs", "docs", "times", "many"))])
LINKS_SQL = f"slice long, stripe int, {', '.join(f'{c} array<long>' for c in DOCS)}, digest array<string>, pairs binary, runs binary, docs binary, times binary, many binary"


def slice_rows(number: int, ids: list, texts: list[str], aligner: Aligner) -> Iterator[tuple]:
    """The rows of a slice: stripe -1 holds its documents, the others the links by B id.

    pairs: distinct links (u8); runs: how many documents hold each (u4); docs: these, one after another (u2); times: how
    often each does (u1, 255 stands for the next entry of `many`, u4).
    """
    numbers, known = aligner.slice(texts)
    counts, digests, links = [], [], []
    for k, n in enumerate(numbers):
        if n is None:
            counts.append((0, 0, 0))
            digests.append("")
            continue
        counts.append(known.n[n].sum(axis=0).tolist())
        digests.append(sha256(b";".join([known.texts[i] for i in n.tolist()])).hexdigest())
        pair, times = np.unique(of_links(n, known), return_counts=True)
        links.append((pair, np.full(len(pair), k, dtype="<u2"), times))
    yield (number, -1, ids, *([c[i] for c in counts] for i in range(3)), digests, None, None, None, None, None)
    if not links:
        return
    pair, doc, times = (np.concatenate(x) for x in zip(*links, strict=True))
    order = np.argsort(pair, kind="stable")
    pair, doc, times = pair[order], doc[order], times[order]
    stripes = (pair >> np.uint64(32)).astype(np.int64) // STRIPE
    bounds = [0, *(np.flatnonzero(np.diff(stripes)) + 1).tolist(), len(pair)]
    for i, j in zip(bounds, bounds[1:], strict=False):
        distinct, runs = np.unique(pair[i:j], return_counts=True)
        t = times[i:j]
        data = [distinct.astype("<u8"), runs.astype("<u4"), doc[i:j], np.minimum(t, 255).astype("<u1"), t[t >= 255].astype("<u4")]
        yield (number, int(stripes[i]), None, None, None, None, None, *(x.tobytes() for x in data))


def links_of(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(id, text) -> the rows of all slices."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = aligner_of(a_path, b_path), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = list(slice_rows(number, ids, texts, aligner))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LINKS, strict=True)], schema=LINKS)

        for batch, some in slices(batches, "text", SLICE // 4):
            for i, t in zip(batch.column(0).to_pylist(), some, strict=True):
                if texts and (size + len(t) > SLICE or len(texts) == DOCUMENTS):
                    yield out()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(t.decode())
                size += len(t)
        if texts:
            yield out()

    return df.mapInArrow(work, LINKS_SQL)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, runs, times) of a slice's links."""
    pairs, runs, times, many = (np.frombuffer(row[c], dtype=t) for c, t in (("pairs", "<u8"), ("runs", "<u4"), ("times", "<u1"), ("many", "<u4")))
    times = times.astype(np.int64)
    times[times == 255] = many
    return pairs, runs, times


def pair_counts(links: DataFrame) -> DataFrame:
    """(stripe, b, a, n): how many links of the corpus hold the pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, runs, times = unpacked(row)
                n = np.add.reduceat(times, np.concatenate([[0], np.cumsum(runs)[:-1]]).astype(np.int64))
                b, a = (pairs >> np.uint64(32)).astype(np.int32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["stripe"], dtype=np.int32)), pa.array(b), pa.array(a), pa.array(n)], ["stripe", "b", "a", "n"])

    sums = links.where("stripe >= 0").select("stripe", "pairs", "runs", "times", "many").mapInArrow(work, "stripe int, b int, a int, n long")
    return sums.groupBy("stripe", "b", "a").agg(F.sum("n").alias("n"))


def best_of(stripe: int, b: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs in order, counts, whether a count is its B id's highest) of a stripe, a dense matrix at a time."""
    order = np.argsort(b.astype(np.int64) << 32 | a, kind="stable")
    b, a, n = b[order].astype(np.int64), a[order].astype(np.int64), n[order]
    matrix = np.zeros((BLOCK, int(a.max(initial=0)) + 1), dtype=np.int64)
    counts, best = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=bool)
    for base in range(stripe * STRIPE, (stripe + 1) * STRIPE, BLOCK):
        i, j = np.searchsorted(b, [base, base + BLOCK])
        if i < j:
            at = b[i:j] - base, a[i:j]
            np.add.at(matrix, at, n[i:j])
            counts[i:j] = matrix[at]
            best[i:j] = counts[i:j] == matrix.max(axis=1)[at[0]]
            matrix[at] = 0
    return b << 32 | a, counts, best


def best_links(counts: DataFrame) -> DataFrame:
    """(stripe, pairs, counts, best): a stripe's pairs in one row, as 8, 8 and 1 bytes each."""

    def work(rows: pa.Table) -> pa.Table:
        stripe = rows.column("stripe")[0].as_py()
        pairs, n, best = best_of(stripe, *(rows.column(c).to_numpy() for c in ("b", "a", "n")))
        data = [pairs.astype("<u8").tobytes(), n.astype("<i8").tobytes(), best.tobytes()]
        return pa.table({"stripe": pa.array([stripe], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip(("pairs", "counts", "best"), data, strict=True)}})

    return counts.groupBy("stripe").applyInArrow(work, "stripe int, pairs binary, counts binary, best binary")


def scored(links: DataFrame, best: DataFrame, lots: int) -> DataFrame:
    """(slice, n_best, count_sum): what a stripe adds to the documents of a slice, as 4 and 8 bytes each, up to the last that has links."""

    def work(some: pa.Table, counts: pa.Table) -> pa.Table:
        rows = []
        known = counts.to_pylist()
        if known:
            all_pairs, n, high = (np.frombuffer(known[0][c], dtype=t) for c, t in (("pairs", "<u8"), ("counts", "<i8"), ("best", "?")))
        for batch in some.to_batches(max_chunksize=1):
            (row,) = batch.to_pylist()
            (pairs, runs, times), docs = unpacked(row), np.frombuffer(row["docs"], dtype="<u2")
            at = np.repeat(np.searchsorted(all_pairs, pairs), runs)
            n_best, total = np.zeros(int(docs.max()) + 1, dtype=np.int64), np.zeros(int(docs.max()) + 1, dtype=np.int64)
            np.add.at(n_best, docs, np.where(high[at], times, 0))
            np.add.at(total, docs, times * n[at])
            rows.append((row["slice"], n_best.astype("<u4").tobytes(), total.astype("<i8").tobytes()))
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("slice", pa.int64()), ("n_best", pa.binary()), ("count_sum", pa.binary())))})

    lot = F.pmod(F.xxhash64("slice"), F.lit(lots)).cast("int")
    some = links.where("stripe >= 0").select("stripe", lot.alias("lot"), "slice", "pairs", "runs", "docs", "times", "many")
    copies = best.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    return some.groupBy("stripe", "lot").cogroup(copies.groupBy("stripe", "lot")).applyInArrow(work, "slice long, n_best binary, count_sum binary")


def align_documents(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    docs = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    links = written(links_of(docs, a_path, b_path))
    lots = max(1, -(-links.where("stripe = -1").count() // LOT))
    best = written(best_links(pair_counts(links)))

    def total(rows: pa.Table) -> pa.Table:
        sums, out = rows.select(["n_best", "count_sum"]).to_pylist(), None
        for k, ids in enumerate(rows.column("doc_id").to_pylist()):
            if ids is not None:
                out = rows.slice(k, 1).to_pylist()[0]
        n_best, count_sum = (np.zeros(len(out["doc_id"]), dtype=np.int64) for _ in range(2))
        for row in sums:
            for c, into, kind in (("n_best", n_best, "<u4"), ("count_sum", count_sum, "<i8")):
                if row[c] is not None:
                    x = np.frombuffer(row[c], dtype=kind)
                    into[: len(x)] += x
        columns = [*(out[c] for c in DOCS), out["n_groups"], n_best, count_sum]  # a group has one link
        names = [*DOCS, "n_links", "n_best", "count_sum"]
        return pa.table({**{c: pa.array(x, pa.int64()) for c, x in zip(names, columns, strict=True)}, "groups_sha256": pa.array(out["digest"], pa.string())})

    sums = scored(links, best, lots)
    rows = links.where("stripe = -1").select("slice", *DOCS, "digest").unionByName(sums, allowMissingColumns=True)
    schema = f"{', '.join(f'{c} long' for c in DOCS)}, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("slice").applyInArrow(total, schema).withColumnRenamed("doc_id", id_col)


def aligned_groups(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): each document's groups as text, `a1,a2|b1;a3|b2,b3`; empty without tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        for batch, texts in slices(batches, "text"):
            numbers, known = aligner.slice([t.decode() for t in texts])
            groups = ["" if n is None else b";".join([known.texts[i] for i in n.tolist()]).decode() for n in numbers]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.string())], ["id", "groups"])

    docs = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return docs.mapInArrow(work, "id long, groups string").withColumnRenamed("id", id_col)


def token_table(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(b, a, n, best): how often each pair of ids is linked in all texts, and whether no other A id is more often linked with the B id."""
    docs = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))

    def work(rows: pa.Table) -> pa.Table:
        pairs, n, best = best_of(rows.column("stripe")[0].as_py(), *(rows.column(c).to_numpy() for c in ("b", "a", "n")))
        return pa.table({"b": pa.array((pairs >> 32).astype(np.int32)), "a": pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(n), "best": pa.array(best)})

    return pair_counts(links_of(docs, a_path, b_path)).groupBy("stripe").applyInArrow(work, "b int, a int, n long, best boolean")
