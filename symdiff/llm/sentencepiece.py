"""SentencePiece (BPE) encoding by a max-plus scan over chunks, and decoding.

A BPE encoding is the one path through the lattice of pieces on which every two neighbours are compatible: encoding
their joined text gives just these two. With weight 0 for compatible neighbours and minus infinity for others, it is the
best path of a max-plus system whose states are the last pieces. So a text can be cut anywhere: a chunk's transfer
matrix holds the weight of each pair of states at its two boundaries (a state: the piece that reaches or crosses the
boundary, and how far it does). Matrices are combined associatively, which fixes the state at every boundary, and each
chunk is traced back by itself.

Between two characters that stand side by side in no piece, no piece can cross and any neighbours are compatible: at
such a sure cut all states are one. Short stretches between sure cuts are encoded once per task and remembered.

Documents of up to CHUNK characters are one chunk, encoded where they are read. Longer ones are dealt out by the chunk;
what is gathered per document is its chunks' matrices, a few hundred bytes for every CHUNK characters.

Defined results: a null or empty text has no ids; characters that no piece holds become byte pieces; repeated rows are
each encoded; rows with a null id keep it; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.llm.common import in_small_batches, slices, written

#: At least as long as the longest piece.
CHUNK = 1 << 15
#: Words, and pairs of pieces, that a task remembers, and how long such words are at most.
CACHE, SHORT = 3 << 17, 64
SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: A state where it doesn't matter which piece was last: a text's start or a sure cut.
ANY = -1

State = tuple[int, int]
Matrix = dict[tuple[State, State], float]


class Bpe:
    """A BPE model with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.scores = {p: model.get_score(i) for p, i in self.pieces.items()}
        self.texts = {i: p for p, i in self.pieces.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.pieces))
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.surface = {i: p.replace(SPACE, " ").encode() for p, i in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.trie: dict = {}
        for p, i in self.pieces.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """By merging the best pair again and again, the leftmost of equals; for short texts."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, k)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def compatible(self, a: int, b: int) -> bool:
        got = self.fits.get(a << 20 | b)
        if got is None:
            x, y = self.texts[a], self.texts[b]
            got = self.fits[a << 20 | b] = x[-1] + y[0] not in self.pairs or self.merged(x + y) == [x, y]
        return got

    def sure(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1] not in self.pairs

    def forward(self, text: str, start: int, last: int, stop: int) -> dict[int, int]:
        """The last piece of the best path from (start, last) to each position up to stop that one reaches. A position
        has one such piece at most: it ends the encoding of all that is before."""
        out, fits = {start: last}, self.fits
        for q in range(start, stop):
            before = out.get(q)
            if before is None:
                continue
            node = self.trie
            for p in range(q, stop):
                node = node.get(text[p])
                if node is None:
                    break
                t = node.get("")
                if t is not None and p + 1 not in out:
                    if before != ANY and (fit := fits.get(before << 20 | t)) is not True and (fit is False or not self.compatible(before, t)):
                        continue
                    out[p + 1] = t
            if q + 1 not in out and text[q] not in self.pieces:  # bytes, between two sure cuts
                out[q + 1] = ANY
        return out

    def trace(self, reached: dict[int, int], start: int, end: int, last: int) -> list[int]:
        """The ids of the path from start to end whose last piece is `last`."""
        ids = []
        while end > start:
            ids.append(last)
            end -= len(self.texts[last])
            last = reached[end]
        return ids[::-1]

    def stretch(self, text: str) -> list[int]:
        """Ids of a text without a sure cut."""
        if len(text) == 1:
            return [self.pieces[text]] if text in self.pieces else [self.bytes[b] for b in text.encode()]
        reached = self.forward(text, 0, ANY, len(text))
        return self.trace(reached, 0, len(text), reached[len(text)])

    def cuts(self, text: str) -> list[int]:
        pairs = self.pairs
        return [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in pairs]

    def between_cuts(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit bytes, of a text that starts and ends at sure cuts."""
        known, out, at = self.known, [], 0
        for cut in [*self.cuts(text), len(text)]:
            some = text[at:cut]
            ids = known.get(some)
            if ids is None:
                ids = np.array(self.stretch(some), dtype="<u4").tobytes()
                if len(some) <= SHORT:
                    known[some] = ids
            out.append(ids)
            at = cut
        return b"".join(out)

    def encode_words(self, text: str) -> bytes:
        """Ids of a text that starts and ends at sure cuts, word by word."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        if len(self.fits) > CACHE:
            self.fits.clear()
        words = WORD.findall(text)
        head = text[: len(text) - sum(map(len, words))]  # before the first space
        new, long = {*words, head}.difference(known), {}
        for w in new:
            (known if len(w) <= SHORT else long)[w] = self.between_cuts(w) if w else b""
        if long:
            return known.get(head, long.get(head)) + b"".join([long[w] if len(w) > SHORT else known[w] for w in words])
        return known[head] + b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        return self.encode_words(SPACE + text.replace(" ", SPACE)) if text else b""

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        out = b"".join([surface.get(i, b"") for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")
        return out.removeprefix(" ")

    # Chunks: `around` is a chunk with up to longest - 1 characters before and after it, `at` and `end` are its bounds there.

    def states(self, around: str, at: int) -> list[State]:
        """At the boundary: (how far behind it the last piece ends, that piece)."""
        if at == 0 or at == len(around) or self.sure(around, at):
            return [(0, ANY)]
        out = []
        for o in range(self.longest):
            for n in range(o + 1, self.longest + 1):
                if at + o <= len(around) and at + o - n >= 0 and (t := self.pieces.get(around[at + o - n : at + o])) is not None:
                    out.append((o, t))
        return out

    def first_cut(self, text: str, at: int, end: int) -> int | None:
        return next((k for k in range(at + 1, end) if self.sure(text, k)), None)

    def transfer(self, around: str, at: int, end: int) -> Matrix:
        """The chunk's matrix; weights that are minus infinity are left out."""
        out: Matrix = {}
        exits = self.states(around, end)
        cut = self.first_cut(around, at, end)
        if cut is not None:
            last = next(k for k in range(end - 1, at, -1) if self.sure(around, k))
            tail = self.forward(around, last, ANY, end)
            ends = [x for x in exits if self.reaches(tail, around, end, x)]
        for entry in self.states(around, at):
            head = self.forward(around, at + entry[0], entry[1], cut if cut is not None else end)
            if cut is None:
                out.update({(entry, x): 0.0 for x in exits if self.reaches(head, around, end, x)})
            elif cut in head or at + entry[0] == cut:
                out.update({(entry, x): 0.0 for x in ends})
        return out

    def reaches(self, reached: dict[int, int], text: str, end: int, state: State) -> bool:
        o, t = state
        if t == ANY:
            return end in reached
        start = end + o - len(self.texts[t])
        return start in reached and (reached[start] == ANY or self.compatible(reached[start], t))

    def traced(self, around: str, at: int, end: int, entry: State, leave: State) -> bytes:
        """The chunk's ids from state to state: of the pieces that start in it."""
        begin, stop = at + entry[0], end + leave[0]
        cut = self.first_cut(around, at, end)
        if cut is None or cut < begin:
            return self.pieces_between(around, begin, entry[1], stop, leave[1])
        last = next(k for k in range(end - 1, at, -1) if self.sure(around, k))
        head = self.pieces_between(around, begin, entry[1], cut, ANY)
        return head + self.encode_words(around[cut:last]) + self.pieces_between(around, last, ANY, stop, leave[1])

    def pieces_between(self, text: str, begin: int, first: int, stop: int, last: int) -> bytes:
        if begin >= stop:
            return b""
        if first == ANY and last == ANY:
            return self.between_cuts(text[begin:stop])
        before = stop - len(self.texts[last]) if last != ANY else stop
        reached = self.forward(text, begin, first, before)
        return np.array(self.trace(reached, begin, stop, last if last != ANY else reached[stop]), dtype="<u4").tobytes()


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus: the best sum over the states between."""
    rows: dict[State, list[tuple[State, float]]] = {}
    for (x, y), w in b.items():
        rows.setdefault(x, []).append((y, w))
    out: Matrix = {}
    for (x, y), v in a.items():
        for z, w in rows.get(y, ()):
            if v + w > out.get((x, z), -np.inf):
                out[x, z] = v + w
    return out


def boundary_states(matrices: list[Matrix]) -> list[State]:
    """The best path's state at each boundary, by an associative scan: neighbouring matrices are multiplied, level by level, up to
    the product of all; then, from there down, each product's best state between its two factors is fixed."""
    start = (0, ANY)
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([product(*below[k : k + 2]) if k + 1 < len(below) else below[k] for k in range(0, len(below), 2)])
    states = [start, start]
    for below in levels[-2::-1]:
        found = [states[0]]
        for k in range(0, len(below), 2):
            enter, leave = states[k // 2], states[k // 2 + 1]
            if k + 1 < len(below):
                rest = below[k + 1]
                found.append(max((w + rest[x, leave], x) for (e, x), w in below[k].items() if e == enter and (x, leave) in rest)[1])
            found.append(leave)
        states = found
    return states


@lru_cache(maxsize=2)
def model_of(path: str) -> Bpe:
    return Bpe(path)


def packed(matrix: Matrix) -> bytes:
    return np.array([(*x, *y, w) for (x, y), w in matrix.items()], dtype=np.float64).tobytes()


def unpacked(data: bytes) -> Matrix:
    return {((int(a), int(b)), (int(c), int(d))): w for a, b, c, d, w in np.frombuffer(data).reshape(-1, 5).tolist()}


def encode(df: DataFrame, model_path: str) -> DataFrame:
    """df (id, text) -> (id, ids): ids as little-endian 32-bit bytes."""

    def short(batches):
        bpe = model_of(model_path)
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t.decode()) for t in texts], pa.binary())], ["id", "ids"])

    def cut(batches):
        bpe = model_of(model_path)
        side = bpe.longest - 1
        for batch, texts in slices(batches, "text"):
            for id_, row, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, strict=True):
                text = SPACE + raw.decode().replace(" ", SPACE)
                for no, at in enumerate(range(0, len(text), CHUNK)):
                    end, low = min(len(text), at + CHUNK), max(0, at - side)
                    chunk = [id_, row, no, text[low : end + side], at - low, end - low]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(chunk, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["id", "row", "no", "around", "at", "end"]

    def transfers(batches):
        bpe = model_of(model_path)
        for batch in batches:
            data = [packed(bpe.transfer(*x)) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["row", "no", "matrix"])

    def states(batches):
        for batch in batches:
            for row, found in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                path = boundary_states([unpacked(x["matrix"]) for x in sorted(found, key=lambda x: x["no"])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * (len(path) - 1), pa.int64()), pa.array(range(len(path) - 1), pa.int64()), *(pa.array([s[k] for s in side], pa.int64()) for side in (path[:-1], path[1:]) for k in (0, 1))],
                    ["row", "no", "o1", "t1", "o2", "t2"],
                )

    def trace(batches):
        bpe = model_of(model_path)
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3, 10)]
            data = [bpe.traced(around, at, end, (o1, t1), (o2, t2)) for around, at, end, o1, t1, o2, t2 in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(data, pa.binary())], ["id", "row", "no", "ids"])

    def joined(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                some = batch.column(1)[k].values
                order = np.argsort(some.field("no").to_numpy())
                ids = b"".join(some.field("ids").take(pa.array(order)).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([ids], pa.binary())], ["id", "ids"])

    length = F.coalesce(F.length("text"), F.lit(0))
    few = df.where(length < CHUNK).mapInArrow(short, "id long, ids binary")
    long = df.where(length >= CHUNK).withColumn("row", F.monotonically_increasing_id())
    chunks = written(long.mapInArrow(cut, "id long, row long, no long, around string, at long, end long"))
    matrices = chunks.repartition("row", "no").select("row", "no", "around", "at", "end").mapInArrow(transfers, "row long, no long, matrix binary")
    gathered = matrices.groupBy("row").agg(F.collect_list(F.struct("no", "matrix")).alias("found"))
    placed = gathered.mapInArrow(states, "row long, no long, o1 long, t1 long, o2 long, t2 long")
    parts = chunks.join(placed, ["row", "no"]).select("id", "row", "no", "around", "at", "end", "o1", "t1", "o2", "t2").mapInArrow(trace, "id long, row long, no long, ids binary")
    gathered = parts.groupBy("row").agg(F.first("id").alias("id"), F.collect_list(F.struct("no", "ids")).alias("parts"))
    return few.unionByName(gathered.select("id", "parts").mapInArrow(joined, "id long, ids binary"))


def decode(df: DataFrame, model_path: str) -> DataFrame:
    """df (id, ids) -> (id, ids, text)."""

    def work(batches):
        bpe = model_of(model_path)
        for batch in batches:
            texts = [bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "ids", "text"])

    return df.select("id", "ids").mapInArrow(work, "id long, ids binary, text string")


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_ids, ids_crc32 (of little-endian 32-bit ids), n_chars and sha256 of the decoded text."""
    rows = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    out = decode(encode(rows, model_path), model_path)
    return out.select(
        F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256")
    )
