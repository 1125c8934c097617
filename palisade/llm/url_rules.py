"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed on full digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import with_lookup

#: Rule tables up to this many rows are broadcast (about 100 bytes each); a larger one is joined by shuffle.
BROADCAST_RULES = 200_000
#: Hex digits of SHA-256 that the equi-join uses; the full digest is compared afterwards.
PREFIX_HEX = 8
#: Combinations of labels and path length in the rules up to which they reach the driver and guide the expansion.
MAX_SHAPES = 10_000

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def split_urls(df: DataFrame) -> DataFrame:
    """Adds host and path. Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the end. Both are "" for null or no "://"."""
    tail = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    host = F.regexp_extract(tail, r"\A[^/?#]*", 0)
    path = F.regexp_extract(tail, r"\A[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path)


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_shapes: int = MAX_SHAPES) -> DataFrame:
    """Adds host, path, rule and verdict to pages (which has a column url; other columns stay, but for any of these names).

    A rule fits its host and every subdomain if the path starts with the rule's path. The longest rule (host and path
    together, then the longer host, then the text) wins; of one rule with both verdicts, block does. Without a rule, rule
    is null and verdict is default. Null urls are judged where they are, without a join.
    Null and odd urls have an empty host and path, which fit no rule with a host. An empty rule table leaves the default.

    Each distinct url is expanded once: host suffixes of as many labels as some rule has, times path prefixes of as many
    characters as some rule has. So the expansion is bounded by the rule shapes and not by the url's length. Should there
    be more than MAX_SHAPES of them, a url is expanded to all its host suffixes times all its path prefixes instead.
    """
    rules = rules.filter("verdict IS NOT NULL AND rule_host IS NOT NULL AND rule_path IS NOT NULL").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    shapes = rules.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")).distinct().limit(max_shapes + 1).collect()
    if not shapes:
        return split_urls(pages).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    keyed = rules.select("verdict", "rule_host", "rule_path", _digest(F.col("rule_host"), F.col("rule_path")).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    urls = split_urls(pages.select("url").filter("url IS NOT NULL").distinct()).withColumn("parts", F.split("host", r"\."))
    if len(shapes) <= max_shapes:
        shape = F.explode(F.array(*[F.struct(F.lit(s.labels).alias("labels"), F.lit(s.chars).alias("chars")) for s in sorted(shapes)]))
        parts = urls.withColumn("shape", shape).filter("shape.labels <= size(parts) AND shape.chars <= length(path)")
    else:
        parts = urls.withColumn("labels", F.explode(F.sequence(F.lit(1), F.size("parts")))).withColumn("chars", F.explode(F.sequence(F.lit(0), F.length("path"))))
        parts = parts.withColumn("shape", F.struct("labels", "chars"))
    expressions = parts.select(
        "url",
        F.array_join(F.expr("slice(parts, size(parts) - shape.labels + 1, shape.labels)"), ".").alias("suffix"),
        F.expr("substring(path, 1, shape.chars)").alias("prefix"),
    ).withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
    hits = expressions.withColumn("short", F.substring("digest", 1, PREFIX_HEX)).join(keyed, "short").filter("digest = full")
    order = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("rule_host").alias("t"))
    best = hits.groupBy("url").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order).alias("best"))
    best = best.select(F.col("url").alias("key__"), "best")
    judged = with_lookup(split_urls(pages.filter("url IS NOT NULL")), F.col("url"), best, {"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))})
    without = split_urls(pages.filter("url IS NULL")).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    return judged.unionByName(without)


ORACLE = """
WITH rules(verdict, h, p) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
t AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
s AS (SELECT page_id, url, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
m AS (SELECT s.page_id, s.url, h || p AS rule, verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(h || p) DESC) AS k
      FROM s JOIN rules ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p))
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN m ON m.page_id = s.page_id AND m.k = 1
"""
