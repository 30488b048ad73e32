"""URL filters: host-suffix and path-prefix expressions, joined on hash prefixes, in DataFrame functions only.

A rule is (host, path, verdict). Its lookup key is its host with its path cut after the last slash, so a rule may end
anywhere in a path; the rest of its path is confirmed after the join. Each URL is expanded into the product of its host's
suffixes and its path's prefixes that end in a slash, no deeper than the deepest rule, which loses none: a rule with fewer
labels or slashes is all that can fit. Keys meet on the first 32 bits of their SHA-256; then the full digest and the path
are confirmed, and the longest rule wins (at equal length the longer host, then block before allow, then code point order).

Defined cases: a null URL or one without :// has an empty host and path and fits no rule; repeated and null ids and
repeated rows stay rows of their own; an empty rule table leaves every URL to the default; other columns are kept, whatever their
names, but for those named like the four that are added, in whatever case, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, quoted

# The rules (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A rule table up to this many rows is broadcast (a row is about 0.2 kB, so 20 MB); beyond, the join is shuffled and AQE splits hot keys.
BROADCAST_RULES = 100_000
DEFAULT = "allow"
ADDED = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(?:.*/)?", 0)


def _prefix(key: Column) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def _expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Keys host-suffix + path-prefix; the path's prefixes end in a slash, or are empty."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    steps = F.regexp_extract_all(path, F.lit(r"(?s)[^/]*/"), F.lit(0))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps), F.lit(depth))), lambda k: F.array_join(F.slice(steps, F.lit(1), k), ""))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\x00"), p)))))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict; rules: (host, path, verdict)."""
    keyed = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null and r_path is not null").distinct()
    keyed = keyed.withColumn("r_key", F.concat("r_host", F.lit("\x00"), _directory(F.col("r_path"))))
    bound = keyed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("r_host", r"\.", -1))).alias("labels"), F.max(F.size(F.split(_directory(F.col("r_path")), "/", -1)) - 1).alias("depth")).first()
    own = [c for c in pages.columns if c.lower() not in ADDED]
    kept = [F.col("page").getField(c).alias(c) for c in own]
    host, path = host_and_path(quoted(url_col))
    # The row rides along as a struct, so that no name of its columns meets one of those below.
    base = pages.select(F.struct(*map(quoted, own)).alias("page") if own else F.lit(None).cast("int").alias("page"), host.alias("host"), path.alias("path"))
    if not bound["n"]:
        return base.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = keyed.withColumns({"r_prefix": _prefix(F.col("r_key")), "r_digest": F.sha2("r_key", 256)}).drop("r_key")
    if bound["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    # The row's number keeps repeated rows apart; it is made once, below the only branch of the plan.
    row = base.withColumn("row", F.monotonically_increasing_id())
    spread = row.select("row", "page", "host", "path", F.explode(_expressions(F.col("host"), F.col("path"), bound["labels"], bound["depth"])).alias("key"))
    fits = (F.sha2("key", 256) == F.col("r_digest")) & F.startswith("path", "r_path")
    met = spread.withColumn("prefix", _prefix(F.col("key"))).join(keyed, (F.col("prefix") == F.col("r_prefix")) & fits, "left")
    best = F.max(F.when(F.col("r_digest").isNotNull(), F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.when(F.col("r_verdict") == "block", 1).otherwise(0).alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))))
    # What stands in a row besides its number depends on it, so it is not grouped by.
    out = met.groupBy("row").agg(F.first(F.struct("page", "host", "path")).alias("held"), best.alias("best"))
    return out.select("held.*", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).select(*kept, "host", "path", "rule", "verdict")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL_OP4 = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.*, r_host, r_path, r_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
