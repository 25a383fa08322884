"""URL filtering by host-suffix and path-prefix rules, joined on short hash prefixes and confirmed by full digests.

Every step is a built-in expression. A URL is expanded only into as many host suffixes and path prefixes as the rules
themselves have labels and path segments, so that the number of expressions per URL is bounded by the rule table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import ascii_lower, unused

PREFIX_HEX = 8  # 4 bytes

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or # or the end, A-Z lower-cased; empty without :// or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end; empty without :// or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def directory_of(path: Column) -> Column:
    """A path up to its last slash, which is what rules and URLs are joined on."""
    return F.regexp_extract(path, r"^(.*/)?", 0)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(a).alias("action")) for h, p, a in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to pages, which has a column url.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path. Of several, the longest rule
    (host and path together) wins, then the longer host, then block over allow. rule is null where none fits, verdict
    then is `default`. Null, empty and malformed URLs get empty host and path. Verdicts are found once for each distinct
    URL, so repeated URLs cost one join row; pages keep all their rows and columns, but for columns named as the added ones.
    Long URLs are read whole; empty tables of pages or rules are fine.
    """
    # Rules are numbered by their own text; clashing column names of pages can't reach these frames.
    known = rules.dropDuplicates().select(
        ascii_lower(F.col("rule_host")).alias("rh"), F.coalesce("rule_path", F.lit("")).alias("rp"), "action")
    known = known.withColumn("key", F.concat_ws("\n", "rh", directory_of(F.col("rp"))))
    known = known.withColumn("rule_digest", F.sha2("key", 256))
    known = known.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    size = known.agg(F.max(F.size(F.split("rh", r"\."))), F.max(F.size(F.split("rp", "/")))).first()
    labels, segments = size[0] or 0, size[1] or 0

    urls = pages.select("url").where("url is not null").distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    parts = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size("hl"), F.lit(labels))),
                           lambda i: F.array_join(F.slice("hl", -i, i), "."))
    prefixes = F.array_union(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.least(F.size("pl") - 1, F.lit(segments))),
        lambda i: F.concat(F.array_join(F.slice("pl", 1, i), "/"), F.lit("/"))))
    prefixes = F.when(F.least(F.size("pl") - 1, F.lit(segments)) < 1, F.array(F.lit(""))).otherwise(prefixes)
    wanted = (urls.where("h <> ''").withColumn("hl", parts).withColumn("pl", F.split("p", "/"))
              .where(F.lit(labels) > 0)
              .select("url", "p", F.explode(suffixes).alias("hs"), prefixes.alias("pps"))
              .select("url", "p", "hs", F.explode("pps").alias("pp"))
              .withColumn("digest", F.sha2(F.concat_ws("\n", "hs", "pp"), 256))
              .select("url", "p", "digest", F.substring("digest", 1, PREFIX_HEX).alias("short")))
    hits = (wanted.join(known, "short")
            .where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("p"), F.col("rp"))))
    best = hits.groupBy("url").agg(F.max(F.struct(
        (F.length("rh") + F.length("rp")).alias("long"), F.length("rh").alias("host_long"),
        (F.col("action") == "block").alias("block"), F.concat("rh", "rp").alias("text"), "action")).alias("best"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    of, rule, action = unused(kept, "of", "rule", "action")
    best = best.select(F.col("url").alias(of), F.col("best.text").alias(rule), F.col("best.action").alias(action))
    return (pages.select(*kept).join(best, F.col("url") == F.col(of), "left")
            .select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col(rule).alias("rule"),
                    F.coalesce(action, F.lit(default)).alias("verdict")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
      END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
