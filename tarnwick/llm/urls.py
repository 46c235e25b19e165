"""URL filters by hashed expressions, in DataFrame functions only.

A URL expands into expressions: the suffixes of its host's labels that are a
rule's host, with the path prefixes of the lengths that this host's rules have.
Suffixes and expressions meet rules in equi-joins on a short hash prefix; the
full digest then confirms the match, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

# Verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hex digits of the short hash, and the most distinct numbers of labels of rule hosts (DNS allows 127).
SHORT, MAX_DEPTHS = 8, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from after the first :// up to / ? # or the end, A-Z lower-cased; path from there up to ? # or the end. Null, or no ://: both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark, rules=RULES) -> DataFrame:
    """rules (verdict, host, path) as a DataFrame."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url, ...).

    A rule (verdict, host, path) fits its host and all subdomains where the
    path starts with the rule's.  The longest rule (characters of host and
    path) wins; of equally long ones that of the longer host, then block over
    allow, then the first by code point.  Without a rule `default` holds.  URLs
    are judged once for each distinct host and path head, so rows may repeat
    and page_id may be null; a null url has an empty host and path.  A host of
    very many labels has no more suffixes than rule hosts have depths, and of a
    very long path no more is hashed than the longest rule's.  Columns of other
    names are not read; an empty table gives no rows, and no rules leave all
    to `default`.
    """
    host, path = split_url(F.col("url"))
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
    rules = rules.filter("r_host IS NOT NULL AND verdict IS NOT NULL").distinct()

    depth = F.size(F.split("r_host", r"\."))
    depths = sorted(r[0] for r in rules.select(depth).distinct().limit(MAX_DEPTHS + 1).collect())
    if len(depths) > MAX_DEPTHS:
        raise ValueError(f"rule hosts have over {MAX_DEPTHS} different numbers of labels")
    longest = rules.agg(F.max(F.length("r_path"))).first()[0]
    named = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("head", F.substring("path", 1, longest or 0))
    if longest is None:
        return named.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels = F.split("host", r"\.")
    # A slice from -n holds the last n labels; of a host with fewer it would be empty.
    hosts = F.array_compact(F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in depths]))
    keys = named.filter("host != ''").select("host", "head").distinct()

    # Suffixes that are a rule's host, with the lengths of that host's rule paths: path prefixes of no others are hashed.
    suffixes = keys.select("host").distinct().select("host", F.explode(hosts).alias("suffix")).withColumn("full", F.sha2("suffix", 256))
    owners = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")).withColumn("r_full", F.sha2("r_host", 256))
    short = lambda c: F.substring(c, 1, SHORT).alias("short")
    owned = suffixes.select("*", short("full")).join(owners.select("r_full", "lengths", short("r_full")), "short").filter("full = r_full")
    owned = written(owned.select(F.col("host").alias("o_host"), "suffix", "lengths"), "url-hosts")

    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    expressions = keys.join(owned, F.col("host") == F.col("o_host")).select("host", "head", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("head"))).alias("n"))
    expressions = expressions.withColumn("full", digest(F.col("suffix"), F.expr("substring(head, 1, n)"))).select("host", "head", "full", short("full"))
    rules = rules.withColumn("r_full", digest(F.col("r_host"), F.col("r_path"))).select("*", short("r_full"))
    met = expressions.join(rules, "short").filter("full = r_full")
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("verdict") == "block").cast("int").alias("b"))
    best = met.groupBy("host", "head").agg(F.max(F.struct(rank.alias("rank"), F.concat("r_host", "r_path").alias("rule"), "verdict")).alias("best"))
    # Written, so that the join below meets it as a table of known size: sent to all if small, else a hot host's rows are split.
    best = written(best.select(F.col("host").alias("b_host"), F.col("head").alias("b_head"), "best.rule", "best.verdict"), "url-verdicts")
    out = named.join(best, (F.col("host") == F.col("b_host")) & (F.col("head") == F.col("b_head")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


OP5_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), s AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s
), r(verdict, r_host, r_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), d AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(verdict, length(r_host || r_path)) AS verdict
  FROM d JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path
)
SELECT page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
