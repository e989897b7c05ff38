"""URL filter: pattern rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a regular expression over a URL's host, path and query, with the literal tokens (runs of a-z and 0-9) that every
match holds. The tokens' numbers of URLs are counted over the whole table (as many rows as rules have tokens), and each rule
is filed under its rarest one. A URL's own tokens fetch the rules filed under them from a hash table, so that what a URL costs
doesn't grow with the rules, and only these expressions are run; a rule without tokens is run on every URL.
Host rules (`host/path`, for a host and its subdomains and for paths with that beginning) are such patterns too; the
longest one that fits decides. Where none fits, a URL is blocked if a pattern rule matches, otherwise allowed. Pattern rules
see A-Z lower-cased; host rules see paths as they are.

The filter is row-local: the rules (at most MOST_RULES, a parameter of the job and not of the data) are a constant of the plan.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and is allowed; ties between
rules go to the greater rule string; repeated rows are each judged; rows with a null id keep it; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """name: the rule string of a host rule, None for a pattern rule; longer names win, any name wins over none."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None = None


def host_rule(verdict: str, name: str) -> Rule:
    host, _, path = name.partition("/")
    pattern = rf"^([^/?]*\.)?{re.escape(host)}/{re.escape(path)}"
    return Rule(pattern, tuple(re.findall("[a-z0-9]+", f"{host}/{path.rpartition('/')[0]}")), verdict, name)


def blocking(pattern: str, literal: str) -> Rule:
    """A pattern rule whose literal stands between characters that aren't of tokens."""
    return Rule(pattern.format(re.escape(literal)), tuple(re.findall("[a-z0-9]+", literal)), "block")


# Patterns around a literal: a label of the host, a segment of the path, its last segment's suffix, a key of the query.
LABEL, SEGMENT, SUFFIX, KEY = r"^([^/?]*\.)?{}\.[^/?]", r"^[^/?]*/([^?]*/)?{}([/?]|\z)", r"^[^/?]*/[^?]*\.{}(\?|\z)", r"\?([^#]*&)?{}="


# The host rules, and places that serve no content to learn from.
HOST_RULES = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))
LABELS = """casino-win ads-track spam-farm adult-x cheap-pills free-bets porn xxx casino betting viagra adserver doubleclick
ads adservice adclick admanager affiliates bannerads clicktrack popads popunder tracking telemetry pixel escorts
livecams sexcams hentai poker slots roulette sportsbet lottery payday-loans quick-loans replica-watches cialis pharmacy-online
essay-writing torrents warez cracks keygen phishing malware linkfarm link-exchange parked-domain domain-for-sale""".split()
SEGMENTS = """ads adserver ad-click adclick banner-ads sponsored-links affiliate affiliates popunder clicktrack tracking-pixel
login log-in signin sign-in signup sign-up logout password-reset forgot-password my-account cart checkout wishlist add-to-cart
wp-admin wp-login.php wp-json wp-content wp-includes xmlrpc.php cgi-bin phpmyadmin administrator admin.php
captcha unsubscribe print-version trackback share-this send-to-friend online-casino sports-betting payday-loans
viagra cialis replica-watches porn xxx escorts webcams hentai warez keygen torrents""".split()
SUFFIXES = """jpg jpeg png gif svg webp ico bmp tiff css js mjs map woff woff2 ttf eot mp3 mp4 avi mov webm ogg wav flac
zip gz tgz bz2 xz 7z rar iso dmg exe msi apk deb rpm jar bin torrent swf""".split()
KEYS = """adurl ad_id adid aff_id affid affiliate_id clickid click_id popunder phpsessid jsessionid sessionid session_id
sid replytocom add-to-cart add_to_cart unsubscribe captcha redirect_to return_to login_redirect""".split()
RULES = (*HOST_RULES, *(blocking(p, x) for p, literals in ((LABEL, LABELS), (SEGMENT, SEGMENTS), (SUFFIX, SUFFIXES), (KEY, KEYS)) for x in literals))


def parts_of(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the query with its question mark."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substr(text, F.instr(text, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)


def tokens_of(place: Column) -> Column:
    return F.array_distinct(F.split(F.translate(place, UPPER, LOWER), "[^a-z0-9]+"))


def place_of(token: str, places: int) -> int:
    return crc32(token.encode()) % places


def hash_table(values: dict[str, object], kind: str) -> Callable[[Column], Column]:
    """What an array constant with a place for each hash says of a token: the array with its value, or an empty one. Looking a
    token up takes the same time however many there are."""
    places = 1 << max(4, (2 * len(values)).bit_length())
    rows: list[list[dict]] = [[] for _ in range(places)]
    for t, v in values.items():
        rows[place_of(t, places)].append({"token": t, "value": v})
    constant = F.from_json(F.lit(json.dumps(rows)), f"array<array<struct<token string, value {kind}>>>")
    at = lambda t: F.get(constant, F.pmod(F.crc32(t.cast("binary")), F.lit(places)).cast("int"))
    return lambda t: F.transform(F.filter(at(t), lambda e: e["token"] == t), lambda e: e["value"])


def token_index(places: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """The rules with tokens by the one that is rarest in places (place)."""
    known = hash_table(dict.fromkeys((t for r in rules for t in r.tokens), 1), "int")
    some = F.filter(tokens_of(F.col("place")), lambda t: F.size(known(t)) > 0)
    counts = {r.token: r["count"] for r in places.select(F.explode(some).alias("token")).groupBy("token").count().collect()}
    out: dict[str, list[Rule]] = {}
    for r in (r for r in rules if r.tokens):
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    return out


RULE = "array<struct<rank int, rule string, verdict string, pattern string>>"


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of df: id, host, path, rule, verdict, and whether a pattern rule matched."""
    if not 0 < len(rules) <= MOST_RULES:
        raise ValueError(f"no rules, or more than {MOST_RULES}")
    host, path, query = parts_of(df[url_col].cast("string"))
    rows = df.select(df[id_col].cast("long").alias("id"), host.alias("host"), path.alias("path"), F.concat(host, path, query).alias("place"))
    index = token_index(rows.select("place"), rules)
    place = F.col("place")
    told = {t: [{"rank": len(r.name or ""), "rule": r.name, "verdict": r.verdict, "pattern": r.pattern} for r in rs] for t, rs in {"": [r for r in rules if not r.tokens], **index}.items()}
    filed = hash_table(told, RULE)
    asked = F.array_distinct(F.concat(F.array(F.lit("")), tokens_of(place)))
    found = F.flatten(F.flatten(F.transform(asked, filed)))
    seen = lambda r: F.when(r["rule"].isNull(), F.translate(place, UPPER, LOWER)).otherwise(place)
    matched = rows.withColumn("best", F.array_max(F.filter(found, lambda r: F.regexp_like(seen(r), r["pattern"]))))
    best = F.col("best")
    return matched.select(
        F.col("id").alias(id_col), "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit("allow")).alias("verdict"), (best.isNotNull() & best["rule"].isNull()).alias("by_pattern")
    )


def filter_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """filter_urls over pages in DuckDB SQL, without an index."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    named = sorted((r for r in rules if r.name), key=lambda r: (-len(r.name), r.name))
    case = lambda value: " ".join(f"WHEN regexp_matches(place, {text(r.pattern)}) THEN {text(value(r))}" for r in named)
    bad = " OR ".join(f"regexp_matches(lowered, {text(r.pattern)})" for r in rules if not r.name)
    return f"""
    WITH parts AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    places AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query FROM parts),
    keyed AS (SELECT *, host || path || query AS place, translate(host || path || query, '{UPPER}', '{LOWER}') AS lowered FROM places),
    ruled AS (SELECT *, CASE {case(lambda r: r.name)} END AS rule, {bad} AS bad FROM keyed)
    SELECT page_id, host, path, rule, CASE {case(lambda r: r.verdict)} WHEN bad THEN 'block' ELSE 'allow' END AS verdict, rule IS NULL AND bad AS by_pattern FROM ruled
    """
