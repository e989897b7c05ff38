"""Hierarchical multi-length packing of token sequences.

Documents are cut into whole windows of the longest context and a rest, the rest is routed to the smallest tier (a power
of two) that holds it. Tiers are packed from the longest down: a window opens with the tier's longest rest, its gap is
filled with the longest rests of the same and then of shorter tiers that fit, and what is still open is closed by
cutting one rest, whose remainder is routed anew. So every closed window is full. The rests that are left when a
partition ends are laid end to end into windows of decreasing powers of two, which are full as well.

Packing is local to a partition of the input: no shuffle, nothing is gathered, and a lost executor's partition is packed
again to the same rows. Token ids are held for at most `BUFFER` tokens or `DOCUMENTS` documents, plus one document: packing leaves
less than one window of the longest tier. Sequence ids hold the
partition's number in their upper bits. Step groups: a partition's sequences are dealt, longest first, to the group with
the fewest tokens, for groups of about `STEP_TOKENS`.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed each for itself; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame

from symdiff.llm.common import Memory, in_small_batches, releasing, slices

LONGEST = 4096
SHORTEST = 256
TIERS = tuple(1 << k for k in range(SHORTEST.bit_length() - 1, LONGEST.bit_length()))
END_ID = 2
#: Tokens in rests that wait in a partition's tiers before packing starts.
BUFFER = 1 << 21
#: Documents that wait before packing starts, however short.
DOCUMENTS = 1 << 16
STEP_TOKENS = 1 << 18
#: Words whose letters' ids a worker remembers, which it does through later stages too.
CACHE = 1 << 17
#: Bytes of text that are split into words at once.
SLICE = 1 << 20


#: ASCII marks that always start a token of their own after a letter (not the apostrophe of a contraction).
MARKS = '!#$%&()*+,-./:;<=>?@[\\]^_`{|}~"'
WORD_END = "</w>"


class WordTokenizer:
    """Ids as little-endian 32-bit bytes, for tokenizers of lower-cased words with word ends that drop white space.

    What stands between spaces or line feeds never shares a token with its neighbours, so each distinct word of a slice
    is looked up once and its ids are dealt to where it stands. A word is letters and marks after them, whose tokens
    don't meet either, so these are remembered apart; letters of many words are encoded in one call and told apart by
    their word ends. Whatever looks otherwise is encoded by itself.
    """

    #: Lower-case letters up to U+024F and marks; or something else, which leaves both groups empty.
    WORD = re.compile(rf"^([a-zß-öø-\u024f]*)([{re.escape(MARKS)}]*)$|^.*$", re.M)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.letters, self.others = Memory(CACHE), Memory(CACHE // 4)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(x.ids, dtype="<u4")

    def learn(self, letters: set[str], others: set[str]) -> None:
        todo, known = list(self.letters.missing(letters)), self.letters.new
        single: list[str] = []
        for at in range(0, len(todo), 512):
            some = todo[at : at + 512]
            (ids,) = self.ids([" ".join(some)])
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(some):
                single += some
                continue
            data, start = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist(), strict=True):
                known[w], start = data[start:end], end
        for words, into in ((single, known), (list(self.others.missing(others)), self.others.new)):
            for at in range(0, len(words), 4096):
                some = words[at : at + 4096]
                into.update((w, x.tobytes()) for w, x in zip(some, self.ids(some), strict=True))

    def ids_of(self, words: pa.Array) -> list[bytes]:
        """Of words without line feeds."""
        if not len(words):
            return []
        lines = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar("\n", words.type))[0].as_py()
        split = self.WORD.findall(lines.lower())
        other = [i for i, (core, marks) in enumerate(split) if not core and not marks]
        alone = words.take(pa.array(other, pa.int64())).to_pylist()
        self.learn({core for core, _ in split if core}, {marks for _, marks in split if marks}.union(alone))
        letters, others = self.letters.new, self.others.new
        out = [letters[core] + others[marks] if core and marks else letters[core] if core else others[marks] if marks else b"" for core, marks in split]
        for i, w in zip(other, alone, strict=True):
            out[i] = others[w]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pa.compute.replace_substring(pa.compute.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        split = pa.compute.split_pattern(texts, " ")
        ends, words, n = split.offsets.to_numpy(), pa.compute.dictionary_encode(split.flatten()), len(texts)
        del texts, split
        found = pa.array(self.ids_of(words.dictionary), pa.large_binary()).take(words.indices)
        _, offsets, data = found.buffers()
        if data is None:
            return [b""] * n
        at = np.frombuffer(offsets, dtype=np.int64)[ends].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One for all tasks of a worker: what it remembers is bounded."""
    return WordTokenizer(path)


def tier_of(length: int) -> int:
    return max(SHORTEST, 1 << (length - 1).bit_length())


class Packer:
    """Pieces are (length, number, start): `number` finds a document's id, ids and token count. Waiting pieces lie on a stack for
    each length; `mask` has a bit for each length that has any, so the longest one that fits is found at once."""

    def __init__(self, first_sequence: int):
        self.next = first_sequence
        self.docs: dict[int, tuple[object, bytes, int]] = {}
        self.held: dict[int, int] = {}
        self.stacks: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0
        self.totals = dict.fromkeys(TIERS, 0)
        self.waiting = 0
        self.rows: list[tuple] = []
        self.count = 0

    def add(self, doc_id, ids: bytes) -> None:
        number, n = self.count, len(ids) // 4
        self.count += 1
        self.docs[number] = (doc_id, ids, n)
        self.held[number] = n
        whole = n - n % LONGEST
        for start in range(0, whole, LONGEST):
            self.write(LONGEST, [(LONGEST, number, start)])
        if n > whole:
            self.route((n - whole, number, whole))
        if self.waiting > BUFFER or len(self.docs) > DOCUMENTS:
            self.pack()

    def route(self, piece: tuple[int, int, int]) -> None:
        length, number, start = piece
        self.stacks.setdefault(length, []).append((number, start))
        self.mask |= 1 << length
        self.totals[tier_of(length)] += length
        self.waiting += length

    def write(self, window: int, pieces: list[tuple[int, int, int]]) -> None:
        offset = 0
        for length, number, start in pieces:
            doc_id, ids, n = self.docs[number]
            self.rows.append((doc_id, start, length, crc32(ids[4 * start : 4 * (start + length)]), n, self.next, offset, window))
            offset += length
            self.held[number] -= length
            if not self.held[number]:
                del self.held[number], self.docs[number]
        self.next += 1

    def pop(self, length: int) -> tuple[int, int, int]:
        stack = self.stacks[length]
        number, start = stack.pop()
        if not stack:
            del self.stacks[length]
            self.mask ^= 1 << length
        self.totals[tier_of(length)] -= length
        self.waiting -= length
        return length, number, start

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest waiting piece of at most so many tokens."""
        fitting = self.mask & ((2 << most) - 1)
        return self.pop(fitting.bit_length() - 1) if fitting else None

    def pack(self) -> None:
        """Closes windows, longest tier first, until a tier and the shorter ones together hold less than one of its windows."""
        for tier in reversed(TIERS):
            while self.totals[tier] and sum(n for t, n in self.totals.items() if t <= tier) >= tier:
                pieces = [p := self.take(tier)]
                gap = tier - p[0]
                while gap and (p := self.take(gap)):
                    pieces.append(p)
                    gap -= p[0]
                if gap:  # every piece that waits is longer than the gap: the shortest one is cut
                    length, number, start = self.pop((self.mask & -self.mask).bit_length() - 1)
                    pieces.append((gap, number, start))
                    self.route((length - gap, number, start + gap))
                self.write(tier, pieces)

    def close(self) -> None:
        self.pack()
        rest = [self.take(LONGEST) for _ in range(sum(map(len, self.stacks.values())))][::-1]  # the longest is taken from the end
        left = sum(p[0] for p in rest)
        while left:
            window = gap = min(LONGEST, 1 << (left.bit_length() - 1))
            pieces = []
            while gap:
                length, number, start = rest.pop()
                cut = min(gap, length)
                pieces.append((cut, number, start))
                if cut < length:
                    rest.append((length - cut, number, start + cut))
                gap -= cut
            self.write(window, pieces)
            left -= window

    def drain(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def step_groups(rows: list[tuple], first_group: int) -> list[int]:
    """A group for each row's sequence; groups get nearly equal token counts."""
    windows = {r[5]: r[7] for r in rows}
    n = max(1, round(sum(windows.values()) / STEP_TOKENS))
    loads = [(0, first_group + k) for k in range(n)]
    group = {}
    for sequence in sorted(windows, key=lambda s: (-windows[s], s)):
        load, k = heapq.heappop(loads)
        group[sequence] = k
        heapq.heappush(loads, (load + windows[sequence], k))
    return [group[r[5]] for r in rows]


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group")])
#: Rows that a partition keeps back to balance their step groups together.
ROWS = 1 << 14


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        tokenizer, packer = tokenizer_of(tokenizer_path), Packer(partition << 40)
        end, rows, groups = np.array([END_ID], dtype="<u4").tobytes(), [], partition << 40

        def out() -> pa.RecordBatch:
            nonlocal rows, groups
            group = step_groups(rows, groups)
            groups = max(group) + 1
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(8)]
            rows = []
            return pa.RecordBatch.from_arrays([*columns, pa.array(group, pa.int64())], schema=SCHEMA)

        for batch, _ in slices(batches, "text", SLICE):
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1)), strict=True):
                packer.add(doc_id, ids + end)
            rows += packer.drain()
            if len(rows) >= ROWS:
                yield out()
        packer.close()
        rows += packer.drain()
        if rows:
            yield out()

    chosen = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    schema = ", ".join(f"{n} long" for n in SCHEMA.names)
    return chosen.mapInArrow(releasing(work), schema).withColumnRenamed("doc_id", id_col)
