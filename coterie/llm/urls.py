"""URL filters (operator 4), in DataFrame functions only.

Two rule kinds. Host rules (host, path prefix, verdict) fit a host and its subdomains; the longest that
fits decides. Urls that none fits go to pattern rules, which are regular expressions. Both are index
tables that urls fetch from by key: host rules under their host, asked for by the suffixes of a url's host;
pattern rules under the rarest of their literal tokens, rarity being the token's count over all urls of the
table, asked for by the url's tokens. Only the rules so fetched compare paths or run expressions, so the
cost of a url follows its tokens and not the number of rules. The verdict follows from the url alone, so
distinct urls are judged once. The index tables are broadcast up to BROADCAST_RULES rows and joined beyond.

Cases: null urls and urls without `://` have an empty host and path, no host rule, and are judged by
patterns on the empty url, so allowed; of equally long rules that fit (the same host and path listed twice)
the one last by verdict wins; block patterns win over allow patterns; pattern rules without a literal token
run on every url; very long urls are judged whole; repeated rows are judged each alike; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

HOST_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: (pattern, literal tokens every match holds as whole runs of [a-z0-9], verdict). Block wins over allow.
PATTERN_RULES = (
    (r"(^|[./-])ads?-track([./-]|$)", ("track",), "block"),
    (r"(^|[./-])spam-farm([./-]|$)", ("spam", "farm"), "block"),
    (r"(^|[./-])cheap-pills([./-]|$)", ("cheap", "pills"), "block"),
    (r"(^|[./-])free-bets([./-]|$)", ("free", "bets"), "block"),
    (r"(^|[./-])adult-[a-z0-9]+([./-]|$)", ("adult",), "block"),
    (r"(^|[./-])casino([./-]|$)", ("casino",), "block"),
    (r"(^|[./-])doubleclick([./-]|$)", ("doubleclick",), "block"),
    (r"(^|[./-])adserver([./-]|$)", ("adserver",), "block"),
    (r"/login(/|\?|$)", ("login",), "block"),
    (r"[?&]sessionid=", ("sessionid",), "block"),
)


BROADCAST_RULES = 500_000


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _index(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table from the driver's list, as one JSON literal that Spark parses."""
    names = [c.split(":")[0] for c in schema.split(",")]
    listed = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{schema}>>")
    out = spark.range(1).select(F.inline(listed))
    return F.broadcast(out) if len(rows) <= BROADCAST_RULES else out


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(url), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, rules: tuple = PATTERN_RULES) -> dict[str, list[int]]:
    """Index: rarest literal token -> numbers of its rules; '' holds the rules without a literal. One pass
    counts the rules' tokens over all urls; what reaches the driver is one number per rule token."""
    tokens = sorted({t for _, literal, _ in rules for t in literal})
    found = urls.select(F.explode(_tokens(_text("url"))).alias("token")).join(_index(urls.sparkSession, [(t,) for t in tokens], "token:string"), "token")
    often = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[int]] = {}
    for i, (_, literal, _) in enumerate(rules):
        index.setdefault(min(literal, key=lambda t: (often.get(t, 0), t)) if literal else "", []).append(i)
    return index


def host_fits(parts: DataFrame, rules: tuple = HOST_RULES) -> DataFrame:
    """parts: (url, host, path). (url, n, rule, verdict) of every host rule that fits."""
    index = _index(parts.sparkSession, [(h, len(h) + len(p), h + p, p, v) for h, p, v in rules], "suffix:string,n:int,rule:string,prefix:string,verdict:string")
    # no suffix of more labels than the longest rule host has can fit
    longest = max((h.count(".") + 1 for h, _, _ in rules), default=1)
    suffixes = F.array(*[F.substring_index("host", ".", -i) for i in range(1, longest + 1)])
    asked = parts.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    return asked.join(index, "suffix").where(F.col("path").startswith(F.col("prefix"))).select("url", "n", "rule", "verdict")


def pattern_hits(urls: DataFrame, rules: tuple = PATTERN_RULES) -> DataFrame:
    """urls: (url). (url, verdict) of every pattern rule that matches, run only where the index fetches it."""
    index = rarest_tokens(urls, rules)
    keyed = _index(urls.sparkSession, [(t, rules[i][0], rules[i][2]) for t, own in index.items() if t for i in own], "token:string,pattern:string,verdict:string")
    asked = urls.select("url", F.explode(_tokens(F.col("url"))).alias("token")).join(keyed, "token")
    hits = asked.where(F.regexp(F.lower("url"), F.col("pattern"))).select("url", "verdict")
    for i in index.get("", []):
        hits = hits.union(urls.where(F.lower("url").rlike(rules[i][0])).select("url", F.lit(rules[i][2]).alias("verdict")))
    return hits


def judge(pages: DataFrame, host_rules: tuple = HOST_RULES, pattern_rules: tuple = PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages."""
    url = _text("url")
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.when(url.contains("://"), url).otherwise("").alias("url"))
    urls = out.select("url").distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    none = F.lit(None).cast("string")
    fits = host_fits(parts, host_rules).select("url", F.struct("n", "rule", "verdict").alias("fit"), none.alias("hit"))
    hits = pattern_hits(urls, pattern_rules).select("url", F.lit(None).cast(fits.schema["fit"].dataType).alias("fit"), F.col("verdict").alias("hit"))
    found = fits.union(hits).groupBy("url").agg(F.max("fit").alias("fit"), F.max("hit").alias("hit"))  # block comes after allow
    verdict = F.coalesce(F.col("fit.verdict"), F.col("hit"), F.lit("allow"))
    out = out.join(found, "url", "left").select("page_id", "url", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", "verdict")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = "\n".join(f"      WHEN (host = {quote(h)} OR host LIKE {quote('%.' + h)}) AND starts_with(path, {quote(p)}) THEN {quote(h + p)}" for h, p, _ in sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1])))
    verdicts = "\n".join(f"    WHEN {quote(h + p)} THEN {quote(v)}" for h, p, v in HOST_RULES)
    block = " OR ".join(f"regexp_matches(lower(u), {quote(p)})" for p, _, v in PATTERN_RULES if v == "block")
    return f"""
WITH urls AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN url ELSE '' END AS u FROM pages),
parts AS (
  SELECT page_id, u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls),
ruled AS (
  SELECT *, CASE
{cases}
      END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE rule
{verdicts}
    ELSE CASE WHEN {block} THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled"""


OP4_ORACLE = _oracle()


def check_rules(rules: tuple = PATTERN_RULES) -> None:
    for pattern, literal, verdict in rules:
        re.compile(pattern)
        assert verdict in ("allow", "block") and all(re.fullmatch("[a-z0-9]+", t) for t in literal)
