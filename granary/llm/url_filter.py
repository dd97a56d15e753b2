"""URL filtering by pattern rules, indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` and names the literal tokens that any match must
contain: whole host labels (``h:org``), words of these (``w:casino``, parts between hyphens) and whole path segments (``p:en``). The rule is
filed under the one of its tokens that fewest URLs hold. A URL's tokens fetch the rules filed under them, and only those run.

All of it is DataFrame functions. Distinct URLs are exploded to their tokens and joined with the index by hash, so a URL costs its tokens and
what these fetch, not the number of rules. The rules are configuration; their table is broadcast up to ``MAX_SENT`` bytes, a larger one
is joined as Spark sees fit. Token counts are one grouped count over the rules' own tokens only.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and gets the default
verdict. Repeated rows are judged alike; an empty table gives an empty result; columns named host, path, rule or verdict are
replaced, all others kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import named, unused

MAX_SENT = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """pattern must match from the start of host + path; longer ``name`` wins, then the smaller one."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    segments = path.split("/")[1:-1]  # what stands before the last slash is whole
    tokens = (*(f"h:{x}" for x in host.split(".")), *(f"p:{x}" for x in segments if x))
    return Rule(host + path, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, len(host + path))


def word_rule(verdict: str, word: str) -> Rule:
    """Fits any host with the word between dots and hyphens; a fallback behind every prefix rule."""
    return Rule(f"{word}", verdict, rf"\A(?:[^/]*[.-])?{re.escape(word)}(?:[.-]|/|\z)", (f"w:{word}",), 0)


#: host and path of each rule, by verdict; longest wins
PREFIXES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: words of host names that mark gambling, adult and spam sites where no prefix rule speaks
JUNK_WORDS = ("adult", "bet", "betting", "cams", "casino", "escort", "escorts", "gambling", "jackpot", "payday", "pharmacy", "pills", "poker", "porn", "porno", "roulette", "sex", "slots", "spam", "viagra", "warez", "xxx")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.translate(F.regexp_extract(F.substr(url, at + 3), r"\A([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def url_tokens(host: Column, path: Column) -> Column:
    """Whole host labels, their words and whole path segments, each once."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(host, "[.-]"), lambda x: F.concat(F.lit("w:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, words, segments))


def _sent(rows: DataFrame, size: int) -> DataFrame:
    return F.broadcast(rows) if size <= MAX_SENT else rows


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (name of the winning rule, else null) and verdict."""
    spark = pages.sparkSession
    kept = [named(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*kept, url_host(named(url)).alias("host"), url_path(named(url)).alias("path"))
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    targets = parts.select("host", "path").where("host <> ''").distinct()
    tokens = targets.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    # how many URLs hold each of the rules' tokens: at most that many rows, whatever the input
    used = sorted({t for r in rules for t in r.tokens})
    own = _sent(spark.createDataFrame([(t,) for t in used], "token string"), sum(map(len, used)) + 40 * len(used))
    seen = {r["token"]: r["n"] for r in tokens.join(own, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    filed = [(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), -r.weight, r.name, r.verdict, r.pattern) for r in rules]
    index = _sent(spark.createDataFrame(filed, "token string, w int, name string, verdict string, pattern string"), sum(sum(map(len, (f[0], *f[2:]))) + 80 for f in filed))
    fits = tokens.join(index, "token").where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    x = unused(parts, "x")
    best = fits.groupBy("host", "path").agg(F.min(F.struct("w", "name", "verdict")).alias(x))
    out = parts.join(best, ["host", "path"], "left")
    rule = F.when(F.col(x)["w"] < 0, F.col(x)["name"])
    return out.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(F.col(x)["verdict"], F.lit(default)).alias("verdict"))


def default_rules() -> list[Rule]:
    return [prefix_rule(*x) for x in PREFIXES] + [word_rule("block", x) for x in JUNK_WORDS]


def op5_url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url"), default_rules()).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"""CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"""
_PATH = r"""CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '\A[^/?#]*([^?#]*)', 1) ELSE '' END"""
ORACLE = f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in PREFIXES)}),
m AS (SELECT u.page_id, u.host, u.path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, u.host, u.path, m.rule,
  coalesce(m.v, CASE WHEN regexp_matches(u.host, '(^|[.-])({"|".join(JUNK_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON m.page_id = u.page_id AND k = 1
"""
