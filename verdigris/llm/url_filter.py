"""URL rules by hash-prefix lookup.

Every URL expands into host suffixes times path prefixes. Expressions meet the
rules on the first 32 bits of their SHA-256; full digests confirm a match, and
the longest rule decides. Columns only: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, boxed, table, unboxed, whole

#: The rules of the contract: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Without a rule, a URL passes.
DEFAULT_VERDICT = "allow"
#: Rules of more bytes than this meet the expressions in a shuffled join.
BROADCAST_BYTES = 8 << 20
PREFIX_HEX = 8


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) as a frame of literals, without a Python worker."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for v, k in zip(r, ("verdict", "host", "path"), strict=True)]) for r in rules])
    return spark.range(1).select(F.inline(rows))


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())).otherwise("")


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds host, path, rule (null without one) and verdict; columns of these names are replaced.

    A rule fits its host and every subdomain if the path starts with the rule's.
    The longest rule wins (host and path together, then host, then block before
    allow). A null URL, or one without ://, has empty host and path and no rule.
    Equal (host, path) pairs are judged once, so a hot host costs no more than its
    distinct paths. An empty rules table leaves every URL at the default. Repeated
    rows stay; other columns, whatever their names, pass through; an empty frame gives none.
    """
    rules = rules.select("verdict", "host", "path", _digest(F.col("host"), F.col("path")).alias("digest")).withColumn("key", F.substring("digest", 1, PREFIX_HEX))
    lengths = sorted(r[0] for r in rules.select(F.char_length("path")).distinct().collect())  # at most as many as a rule's path has characters
    about = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("host") + F.octet_length("path")).alias("bytes")).first()
    few = (about["bytes"] or 0) + 80 * about["n"] <= BROADCAST_BYTES
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url_col]
    url = whole(F.col(f"`{url_col}`"))
    judged = pages.select(boxed(pages), url_host(url).alias("host"), url_path(url).alias("path"))
    distinct = judged.select("host", "path").distinct()
    # suffixes of no more labels than the longest rule's host
    last = F.reverse(F.slice(F.reverse(F.split("host", r"\.")), 1, about["labels"] or 1))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    wide = distinct.withColumn("labels", last).select("host", "path", F.explode(suffixes).alias("suffix"))
    wide = wide.withColumn("size", F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path")))) if lengths else wide.withColumn("size", F.lit(0))
    wide = wide.withColumn("full", _digest(F.col("suffix"), F.expr("substring(path, 1, size)"))).withColumn("key", F.substring("full", 1, PREFIX_HEX))
    right = rules.select("key", "digest", F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path"))
    met = wide.join(F.broadcast(right) if few else right, "key").where(F.col("full") == F.col("digest"))
    order = F.struct((F.char_length("r_host") + F.char_length("r_path")).alias("n"), F.char_length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best"))
    out = judged.join(best, ["host", "path"], "left")
    own = [c for c in names if c not in ("host", "path", "rule", "verdict")]
    return out.select(*unboxed(own), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by RULES: page_id, host, path, rule, verdict. A null url has empty host and path; repeated rows stay."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages
), q AS (
  SELECT page_id,
         CASE WHEN strpos(u, '://') > 0 THEN translate(regexp_extract(substr(u, strpos(u, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN strpos(u, '://') > 0 THEN regexp_extract(substr(u, strpos(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM p
), r(r_verdict, r_host, r_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), pairs AS (
  SELECT DISTINCT host, path FROM q
), best AS (
  SELECT host, path, arg_max(r_host || r_path, length(r_host) + length(r_path)) AS rule, arg_max(r_verdict, length(r_host) + length(r_path)) AS verdict
  FROM pairs JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path
)
SELECT q.page_id, q.host, q.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM q LEFT JOIN best ON q.host = best.host AND q.path = best.path
"""
