"""URL filter: host and path rules first, then a weighted vocabulary matched by Aho-Corasick.

A URL's rule is the longest one whose host equals the URL's host or is a parent of it and
whose path begins the URL's path. Without a rule the vocabulary decides on the whole
URL in lower case: a term counts only between boundaries (no ASCII letter or digit on
either side); one strict term, or ``soft_limit`` distinct soft terms, block.

Null URLs and URLs without ``://`` have an empty host and path; a null URL is allowed.
Rows are judged one by one, so ties, copies and empty tables need no care; other columns
of the input are not read.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenic.llm.common import ascii_lower

# The vocabulary and the rules (verdict, host, path).
STRICT = ("porn", "xxx", "hentai", "camgirls", "escorts", "warez", "malware", "phishing", "ads-track", "click-farm")
SOFT = ("adult", "ads", "affiliate", "bet", "casino", "cheap", "crack", "dating", "gambling", "keygen", "loan", "lottery",
        "nude", "pills", "poker", "promo", "sex", "slots", "torrent", "track", "viagra")
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SOFT_LIMIT = 2

HITS = T.StructType([T.StructField("strict", T.IntegerType()), T.StructField("soft", T.IntegerType())])


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    """Automaton over both lists; a term's value is its length and weight class."""
    a = ahocorasick.Automaton()
    for weight, terms in ((0, soft), (1, strict)):
        for t in terms:
            a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def count_hits(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Distinct strict and soft terms of a lower-cased URL."""
    found: set[tuple[str, int]] = set()
    for last, (term, weight) in automaton(strict, soft).iter(url):
        first = last - len(term) + 1
        if not (first and _inner(url[first - 1])) and not (last + 1 < len(url) and _inner(url[last + 1])):
            found.add((term, weight))
    n = sum(w for _, w in found)
    return n, len(found) - n


def vocabulary_hits(url: Column, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> Column:
    @F.pandas_udf(HITS)
    def hits(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_hits(u, strict, soft) if u else (0, 0) for u in s], columns=["strict", "soft"])

    return hits(ascii_lower(url))


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, strict_hits, soft_hits."""
    host, path = host_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    rows = rows.withColumn("_hits", vocabulary_hits(F.col("_url"), strict, soft))
    rows = rows.select("_id", "_hits", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    bad = (F.col("_hits.strict") > 0) | (F.col("_hits.soft") >= soft_limit)
    return rows.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"),
                       F.coalesce("_rule.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
                       F.col("_hits.strict").alias("strict_hits"), F.col("_hits.soft").alias("soft_hits"))


def oracle() -> str:
    def count(terms):
        return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms)

    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fit = {h + p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in order}
    rule = " ".join(f"WHEN {fit[h + p]} THEN '{h + p}'" for _, h, p in order)
    verdict = " ".join(f"WHEN {fit[h + p]} THEN '{v}'" for v, h, p in order)
    return f"""
WITH a AS (SELECT page_id, COALESCE(translate(url, {low}), '') AS u,
           CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {low}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
      {count(STRICT)} AS strict_hits, {count(SOFT)} AS soft_hits FROM a)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits
FROM b"""
