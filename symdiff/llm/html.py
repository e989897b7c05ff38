"""Main text of web pages: flat text blocks, shallow features and a small decision tree.

A page is cut into text blocks at block-level tags. A block's features are its word count and link density, those of the
block before and after it, and marks of its open elements: whether one of them is a container of page furniture
(by tag, role, class or id), whether the block is a paragraph of an article that is only named like furniture itself, whether one is an
article's, and whether it is a paragraph. A decision tree, grown on a small labelled table of pages, tells
content from the rest; content blocks are joined in page order. The tree looks at furniture, then at the block's own links and words,
which decide for blocks of text and of links, and only then at the other marks and at the neighbours. A form around a whole article isn't furniture.

A class name is one word (`sidebar`) or compound (`site-sidebar`). Compound names that tell of a state (`has-sidebar`,
`comments-open`) say nothing; of an element that is an article by its tag or by a word of one (`content has-menu`), only one-word
names count.

Row-local and linear in a page's length: no shuffle, nothing is gathered.

Defined results: null or empty html and pages without content give an empty text of 0 characters; broken markup is read
as far as it goes, an unclosed script, style, comment or tag lasts to the end of the page, other elements that are left out
only to their end tags, if there are any; repeated rows are each extracted;
rows with a null id keep it; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from symdiff.llm.common import in_small_batches, slices

# Kinds of elements.
RAW = frozenset("script style textarea title iframe xmp noframes".split())
LEFT_OUT = frozenset("noscript template svg select datalist canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr object q ruby rb rp rt s samp small span strike
    strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mspace mstyle
    semantics annotation""".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
# Words of classes, ids and roles.
FURNITURE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar
    navigation menu breadcrumb breadcrumbs sidebar widget related recommended recommendations share sharing social comment
    comments disqus reply replies respond cookie cookies consent notice notices gdpr popup modal overlay newsletter
    subscribe subscription signup login search footer copyright pagination pager toolbar skip complementary contentinfo
    dialog alert teaser outbrain taboola""".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
ARTICLE_WORDS = frozenset("article post entry story content main".split())
STATE_WORDS = frozenset("has have no not without with is are open opened closed enabled disabled allowed off on hide hidden free".split())

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:-->|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b(?!\s*[=-])|(display\s*:\s*none)""", re.I)
WORDS = re.compile(r"[a-z]+")
#: What begins a tag or comment.
BEGUN = re.compile(r"<[a-zA-Z/!?]")
#: The attributes of an anchor that links to nothing.
ANCHOR = re.compile(r"(?i)\A(?!.*\bhref\b).*\b(?:name|id)\s*=", re.S)


@dataclass
class Block:
    text: str
    words: int
    links: float
    furniture: bool
    named: bool
    article: bool
    paragraph: bool


#: What is around a block: nothing that speaks against it; a form, which may hold a whole page; page furniture.
NOTHING, FORM, FURNITURE = range(3)


def kind_of(tag: str, attributes: str, in_article: bool) -> tuple[int, bool, bool]:
    """(furniture by its tag or state, furniture by its names, article) of an element."""
    furniture, article = FORM if tag == "form" else FURNITURE if tag in FURNITURE_TAGS or (tag == "header" and not in_article) else NOTHING, tag in ARTICLE_TAGS
    named = False
    if not attributes or tag in ("html", "body"):
        return furniture, named, article and furniture < FURNITURE
    by_name = FURNITURE_WORDS if in_article else FURNITURE_WORDS | HEADER_WORDS
    names: list[list[str]] = []
    for m in ATTRIBUTE.finditer(attributes):
        if m[5] or m[6]:
            furniture = FURNITURE
        else:
            names += [WORDS.findall(x) for x in html.unescape(m[2] or m[3] or m[4] or "").lower().split()]
    certain = article or any(len(x) == 1 and x[0] in ARTICLE_WORDS for x in names)
    for x in names:
        if len(x) == 1:
            named |= x[0] in by_name
        elif not certain and not STATE_WORDS.intersection(x):
            named |= not by_name.isdisjoint(x)
        article |= not ARTICLE_WORDS.isdisjoint(x)
    return furniture, named, article and furniture < FURNITURE and not named


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, furniture and article with what is around, and whether a paragraph is named like furniture
    opened: Counter = Counter()
    parts: list[str] = []
    linked = 0
    link: int | None = None  # how many block elements were open where the open link began
    at, stop, end = 0, page.rfind(">") + 1, len(page)  # behind the last > there is no whole tag
    unclosed: set[str] = set()  # elements of which no end tag follows

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            n = text.count(" ") + 1
            name, furniture, article, named = stack[-1] if stack else ("", NOTHING, False, False)
            out.append(Block(text, n, min(1.0, linked / n), furniture > NOTHING, named, article, name in PARAGRAPHS))
        linked = 0

    def close(name: str) -> None:
        nonlocal link
        while stack:
            top = stack.pop()[0]
            opened[top] -= 1
            if top == name:
                break
        if link is not None and link > len(stack):  # a link ends with the block that it began in
            link = None

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if link is not None:
            linked += len(text.split())

    while at < stop:
        m = TOKEN.search(page, at, stop)
        if not m:
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = end if m[0].startswith("<!--") and not m[0].endswith("-->") else m.end()
        closing, name = (m[1], m[2]) if m[2] else (m[4], m[5])
        if not name:
            continue
        name = name.lower()
        if name in RAW or name in LEFT_OUT:
            if not closing and not m[0].endswith("/>") and name not in unclosed:
                done = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
                if done:
                    at = done.end()
                elif name in RAW:
                    at = end
                else:
                    unclosed.add(name)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                link = None if closing or ANCHOR.search((m[3] if m[2] else m[6]) or "") else len(stack)
            continue
        flush()
        if closing:
            if opened[name] > 0:
                close(name)
            continue
        if opened["p"] > 0 and stack and stack[-1][0] == "p":  # a block ends the paragraph before it
            close("p")
        if name == "li" and stack and stack[-1][0] == "li":
            close("li")
        _, furniture, article, named = stack[-1] if stack else ("", NOTHING, False, False)
        f, by_name, a = kind_of(name, m[3] if m[2] else m[6], article)
        if by_name and article and name in PARAGRAPHS:  # a paragraph of the article's own: weaker evidence than a box in it
            named = True
        elif by_name:
            f = FURNITURE
        if a and furniture == FORM:  # the page stands in the form, not the form on the page
            furniture = NOTHING
        stack.append((name, max(furniture, f), article or a, named))
        opened[name] += 1
    if at < end:
        begun = BEGUN.search(page, at)
        add(page[at : begun.start()] if begun else page[at:])
    flush()
    return out


FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "furniture", "named", "article", "paragraph")
NONE = Block("", 0, 0.0, False, False, False, False)


def row_of(b: Block, before: Block, after: Block) -> tuple[float, ...]:
    return b.words, b.links, before.words, before.links, after.words, after.links, float(b.furniture), float(b.named), float(b.article), float(b.paragraph)


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    padded = [NONE, *blocks, NONE]
    return [row_of(b, p, n) for p, b, n in zip(padded, blocks, padded[2:], strict=False)]


# The labelled table. Each line is a page, block after block: words, links, marks (f furniture around it, n a paragraph
# named like it, a article around it, p paragraph, - none of them) and the label (1: content).
LABELLED = """
1 1 f 0  1 1 f 0  2 1 f 0  9 0 f 0  10 0 ap 1  60 0 ap 1  45 .05 ap 1  3 0 ap 1  120 0 ap 1  7 0 a 1  12 .2 a 1  3 1 f 0  6 1 f 0  14 .2 f 0
2 1 f 0  8 0 f 0  12 0 ap 1  2 0 ap 1  4 0 ap 1  80 0 ap 1  2 1 ap 1  30 .1 ap 1  1 0 ap 1  40 0 f 0  60 0 f 0  22 0 f 0  5 .2 f 0
5 0 ap 1  50 0 ap 1  8 1 a 1  9 1 a 1  7 1 a 1  12 .9 a 1  2 1 a 1  1 1 a 1  35 0 f 0  25 .9 f 0  9 0 f 0
7 0 ap 1  55 0 ap 1  18 0 nap 1  70 0 ap 1  5 0 nap 0  62 0 ap 1  25 .1 nap 1  48 0 ap 1  4 1 nap 0  33 0 ap 1  3 .5 nap 0  90 0 ap 1  14 0 nap 1  8 0 nap 0  20 .9 nap 0  41 0 ap 1
90 0 f 0  60 0 f 0  35 0 f 0  300 .1 f 0  16 0 f 0  4 0 f 0  28 .3 f 0  110 .02 f 0  1 0 f 0
5 0 p 1  2 0 p 1  70 0 p 1  9 0 p 1  3 0 p 1  24 .2 p 1  3 1 p 0  2 1 p 0  4 .9 p 0  6 .6 p 0
3 1 - 0  2 1 - 0  4 1 - 0  9 0 - 1  60 0 - 1  6 0 - 1  80 0 - 1  35 .1 - 1  5 0 - 1  45 0 - 1  4 0 - 0  2 1 - 0  3 1 - 0
2 1 - 0  4 0 - 0  3 1 - 0  8 .1 - 0  5 1 - 0  6 0 - 0  2 1 - 0  40 .7 - 0  12 .6 - 0  25 .9 - 0  2 0 - 0
1 0 - 0  6 .3 - 0  3 0 - 0  9 .2 - 0  2 0 - 0  22 0 - 1  30 .05 - 1  18 0 - 1  14 .1 - 1  90 .2 - 1  5 0 - 0  3 0 - 0
4 0 p 1  18 .1 p 1  30 .6 p 0  8 0 p 1  15 1 p 0  1 0 p 1
44 0 ap 1  6 1 fa 0  30 .1 fa 0  3 0 fap 0  64 0 fap 0  9 0 ap 1  100 0 fap 0  2 0 fa 0  17 0 ap 1  1 1 fa 0  8 .4 fa 0
90 0 ap 1  4 0 ap 1  85 0 ap 1  6 0 ap 1  150 0 ap 1  2 0 ap 1  7 0 ap 1  70 0 ap 1  9 0 a 1  30 0 a 1  1 0 a 1  55 0 a 1  3 0 a 1  2 0 a 1  8 0 a 1
40 0 ap 1  3 .5 ap 1  60 0 ap 1  8 .4 a 1  75 0 ap 1  2 1 ap 1  90 0 a 1  6 1 a 1  35 0 ap 1  10 .3 ap 1  2 .8 a 1  20 .3 ap 1  5 1 a 1  4 1 a 1  50 0 a 1
80 0 p 1  3 0 p 1  95 0 p 1  2 0 p 1  6 0 p 1  33 0 p 1  8 0 p 1  5 0 p 1  1 0 p 1  48 .1 p 1  7 0 p 1
20 0 a 1  14 1 a 1  6 .5 a 1  3 0 a 1  2 .6 ap 1  11 .9 ap 1  1 0 a 1  400 0 a 1
"""


def labelled() -> list[tuple[float, ...]]:
    """FEATURES and the label of each block of the table, next to its neighbours."""
    rows = []
    for page in LABELLED.split("\n")[1:-1]:
        cells = page.split()
        blocks = [Block("", int(w), float(x), "f" in m, "n" in m, "a" in m, "p" in m) for w, x, m in zip(cells[::4], cells[1::4], cells[2::4], strict=True)]
        rows += [(*row, int(y)) for row, y in zip(features(blocks), cells[3::4], strict=True)]
    return rows


def gini(rows: list[tuple]) -> float:
    p = sum(r[-1] for r in rows) / len(rows)
    return len(rows) * 2 * p * (1 - p)


#: What a split by each of FEATURES counts: a block's own words and links before its neighbours', and before marks that a page may
#: not keep to.
TRUST = (1, 1, .3, .3, .3, .3, 1, 1, .6, .5)


def grow(rows: list[tuple]) -> tuple | int:
    """A tree of (feature, limit, tree for values up to the limit, tree for others), with classes as leaves: each split is the one that
    lowers the Gini impurity most, times TRUST."""
    if len({r[-1] for r in rows}) == 1:
        return rows[0][-1]
    best = None
    for k in range(len(FEATURES)):
        values = sorted({r[k] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            limit = (low + high) / 2
            left, right = [r for r in rows if r[k] <= limit], [r for r in rows if r[k] > limit]
            gain = (gini(rows) - gini(left) - gini(right)) * TRUST[k]
            if best is None or gain > best[0] + 1e-12:
                best = (gain, k, limit, left, right)
    if best is None:
        return int(2 * sum(r[-1] for r in rows) >= len(rows))
    return best[1], best[2], grow(best[3]), grow(best[4])


def classify(tree: tuple | int, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, int):
        feature, limit, low, high = tree
        tree = low if row[feature] <= limit else high
    return bool(tree)


TREE = grow(labelled())


def main_text(page: str, tree: tuple | int = TREE) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if classify(tree, row))


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: id, url, text, n_chars."""

    def work(batches):
        for batch, pages in slices(batches, "html"):
            texts = [main_text(p.decode()) for p in pages]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"]
            )

    chosen = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[url_col].cast("string").alias("url"), df[html_col].cast("string").alias("html"))
    return chosen.mapInArrow(work, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
