"""Secret scan: a trigram inverted index over each slice of documents proposes candidates, regular expressions verify.

Each rule's regular expression is turned into a Boolean trigram query. The postings of the queries' trigrams are
intersected and united for the documents at hand; only documents that satisfy a rule's query run its expression. Rules
without mandatory trigrams (`hex`) read every document. The work is row-local: no shuffle, no state besides a slice.

Defined results: a null or empty text has no spans (its digest is that of the empty string); repeated rows are scanned
each for itself; rows with a null id keep it; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from symdiff.llm.common import in_small_batches, releasing, slices
from symdiff.llm.trigrams import TrigramIndex, candidates, trigram_query, trigrams_of


@dataclass(frozen=True)
class Rule:
    """`least`: characters that group `group` must have; shorter matches are used up but dropped."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 0


# The three base rules come first, in this order.
BASE = (
    Rule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", rb"[0-9a-f]{24,}", 0, 24),
)
# Public formats of tokens and keys.
MORE = (
    Rule("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", rb"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", rb"[rs]k_live_[0-9A-Za-z]{20,}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", rb"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.index = TrigramIndex(set().union(*(trigrams_of(q) for *_, q in self.rules)))

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Of each text: (start, rule's number, end) in code points, in that order."""
        postings = self.index.postings(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, pattern, query) in enumerate(self.rules):
            for i in candidates(query, postings, len(texts)).nonzero()[0]:
                for m in pattern.finditer(texts[i]):
                    if len(m[rule.group]) >= rule.least:
                        found[i].append((m.start(), number, m.end()))
        return [self.in_code_points(t, sorted(x)) if x else x for t, x in zip(texts, found, strict=True)]

    @staticmethod
    def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if text.isascii():
            return spans
        at = {}
        seen = chars = 0
        for x in sorted({y for s in spans for y in (s[0], s[2])}):
            chars += len(text[seen:x].decode("utf-8", "surrogatepass"))
            seen, at[x] = x, chars
        return [(at[s], k, at[e]) for s, k, e in spans]


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], base_only: bool) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans if k < len(BASE) or not base_only)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of df: its id, the base kinds' counts and digest, and all spans."""

    def work(batches):
        scanner = Scanner(rules)
        for batch, texts in slices(batches, "text"):
            found = scanner.scan(texts)
            counts = [[sum(k == n for _, k, _ in x) for x in found] for n in range(len(BASE))]
            digests = [sha256(joined(x, rules, True).encode()).hexdigest() for x in found]
            every = [joined(x, rules, False) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(every, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"],
            )

    chosen = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    out = chosen.mapInArrow(releasing(work), "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")
    return out.withColumnRenamed("id", id_col)


def redact_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with every found span replaced by [KIND] (overlapping spans by the first one's kind); null texts stay null."""
    at = df.columns.index(text_col)

    def work(batches):
        scanner = Scanner(rules)
        for batch, texts in slices(batches, text_col):
            column = batch.column(at)
            new = [None if raw is None else redacted(raw, x, rules) for raw, x in zip(column.to_pylist(), scanner.scan(texts), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return in_small_batches(df).mapInArrow(releasing(work), df.schema)


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    out, done = [], 0
    for start, k, end in spans:
        if start >= done:
            out += [text[done:start], f"[{rules[k].kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
