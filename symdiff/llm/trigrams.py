"""Boolean trigram queries derived from regular expressions, and an inverted index that answers them.

A query is True (nothing is mandatory), a trigram (3 bytes, ASCII case folded), or ("and" | "or", frozenset of queries).
Every text that a pattern matches satisfies the pattern's query; the converse is checked by running the pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

import numpy as np

#: Sets of possible strings beyond this size are turned into queries.
MOST = 64
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def both(op: str, parts) -> object:
    out = set()
    for q in parts:
        if q is True:
            if op == "or":
                return True
        elif isinstance(q, tuple) and q[0] == op:
            out |= q[1]
        else:
            out.add(q)
    return True if not out else next(iter(out)) if len(out) == 1 else (op, frozenset(out))


def needed(strings: set[bytes]) -> object:
    """The query of: one of these strings occurs."""
    return both("or", (both("and", (s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


@dataclass
class Info:
    exact: set[bytes] | None
    starts: set[bytes]
    ends: set[bytes]
    query: object = True

    def known(self) -> "Info":
        """As an expression whose exact strings are no longer listed."""
        return self if self.exact is None else Info(None, self.exact, self.exact, True)

    def bounded(self) -> "Info":
        if self.exact is not None and len(self.exact) <= MOST:
            return self
        x = self.known()
        q = both("and", (x.query, needed(x.starts), needed(x.ends)))
        starts, ends = {s[:2] for s in x.starts}, {s[-2:] for s in x.ends}
        return Info(None, starts if len(starts) <= MOST else {b""}, ends if len(ends) <= MOST else {b""}, q)


ANY = Info(None, {b""}, {b""})


def joined(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        exact = {x + y for x in a.exact for y in b.exact}
        return Info(exact, exact, exact)
    ax, bx = a.known(), b.known()
    cross = needed({x + y for x in ax.ends for y in bx.starts}) if len(ax.ends) * len(bx.starts) <= MOST else True
    starts = {x + y for x in a.exact for y in bx.starts} if a.exact is not None else ax.starts
    ends = {x + y for x in ax.ends for y in b.exact} if b.exact is not None else bx.ends
    return Info(None, starts, ends, both("and", (ax.query, bx.query, cross))).bounded()


def members(items) -> set[bytes] | None:
    out: set[int] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(value)
        elif op is C.RANGE:
            out |= set(range(value[0], value[1] + 1))
        else:
            return None
    folded = {bytes([FOLD[x]]) for x in out}
    return folded if len(folded) <= 8 else None


def info(sequence) -> Info:
    total = Info({b""}, {b""}, {b""})
    for op, value in sequence:
        if op is C.LITERAL:
            one = {bytes([FOLD[value]])}
            part = Info(one, one, one)
        elif op is C.IN and (chars := members(value)):
            part = Info(chars, chars, chars)
        elif op is C.SUBPATTERN:
            part = info(value[-1])
        elif op is C.BRANCH:
            parts = [info(x) for x in value[1]]
            if all(x.exact is not None for x in parts):
                exact = set().union(*(x.exact for x in parts))
                part = Info(exact, exact, exact).bounded()
            else:
                parts = [x.known() for x in parts]
                queries = [both("and", (x.query, needed(x.starts), needed(x.ends))) for x in parts]
                part = Info(None, set().union(*(x.starts for x in parts)), set().union(*(x.ends for x in parts)), both("or", queries)).bounded()
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            inner = info(inner)
            if low == high and low <= 8:
                part = Info({b""}, {b""}, {b""})
                for _ in range(low):
                    part = joined(part, inner)
            elif (low, high) == (0, 1) and inner.exact is not None:
                exact = inner.exact | {b""}
                part = Info(exact, exact, exact)
            else:
                part = inner.known() if low else ANY
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            part = ANY
        total = joined(total, part)
    return total


def trigram_query(pattern: bytes) -> object:
    x = info(P.parse(pattern)).bounded()
    y = x.known()
    return both("and", (y.query, needed(y.starts), needed(y.ends)))


def trigrams_of(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))


class TrigramIndex:
    """Postings of the wanted trigrams over a list of texts; a posting list is a boolean per text."""

    def __init__(self, wanted: set[bytes]):
        self.order = sorted(wanted)
        self.code = np.zeros(1 << 24, dtype=np.uint16 if len(self.order) < 1 << 16 else np.uint32)
        for i, t in enumerate(self.order):
            self.code[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def postings(self, texts: list[bytes], step: int = 1 << 20) -> dict[bytes, np.ndarray]:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        out = np.zeros((len(self.order) + 1, len(texts)), dtype=bool)
        for at in range(0, max(0, len(data) - 2), step):
            folded = FOLD[data[at : at + step + 2]].astype(np.uint32)
            codes = self.code[folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]]
            hits = np.flatnonzero(codes)
            which = np.searchsorted(ends, hits + at, side="right")
            inside = hits + at + 2 < ends[which]
            out[codes[hits[inside]], which[inside]] = True
        return {t: out[i + 1] for i, t in enumerate(self.order)}


def candidates(query: object, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Which texts satisfy the query, by intersecting and uniting postings."""
    if query is True:
        return np.ones(n, dtype=bool)
    if isinstance(query, bytes):
        return postings[query]
    parts = [candidates(q, postings, n) for q in query[1]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)
