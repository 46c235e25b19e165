"""Queries of the temporal, similarity and sketch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import ordered, pruning, similarity, sketches, skew, temporal
from tarnwick.registry import query
from tarnwick.sources.tables import table


@query("""
SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value
FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def op_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("purchase_value"), F.col("event_id").alias("purchase_id"))
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return temporal.asof_join(clicks, bought, "user_id", "ts", "ts", ["purchase_id", "purchase_value"], 7 * 86_400).select("event_id", "purchase_id", "purchase_value")


@query("""
WITH s AS (SELECT s_suppkey, s_acctbal AS low, s_acctbal + 50 AS high FROM supplier)
SELECT c_custkey, s_suppkey FROM customer JOIN s ON c_acctbal >= low AND c_acctbal < high
""")
def op_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return temporal.interval_join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), spans, "c_acctbal", "low", "high", 50).select("c_custkey", "s_suppkey")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def op_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = temporal.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def op_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(temporal.tumbling(F.col("ts"), "1 hour").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events)
SELECT start, count(*) AS n FROM w GROUP BY start
""")
def op_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "1 hour", "30 minutes").start.cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(w.alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query()
def op_distinct_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts per supplier from mergeable sketches, joined into one; the estimate's error is tested."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.hll_sketch_agg("l_partkey").alias("sketch"))
    return per.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("parts"))


@query()
def op_approx_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("med"), F.approx_count_distinct("l_partkey").alias("parts"))


@query("""
WITH n AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (
  SELECT n.vec_id AS query_id, e.vec_id, list_inner_product(CAST(n.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM n JOIN embeddings e ON n.vec_id != e.vec_id)
SELECT query_id, vec_id, round(score, 8) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""")
def op_exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of the stated queries (ids divisible by 50) against all rows: a matrix product for each pair of blocks rules rows out, the others are scored exactly."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return skew.block_search(e, e.filter("id % 50 = 0"), 5).withColumn("score", F.round("score", 8))


@query("""
WITH RECURSIVE t AS (SELECT lower(p_name) AS s, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1),
g AS (SELECT s, n, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3))) AS g FROM t),
p AS (SELECT a.s AS a, b.s AS b FROM g a JOIN g b ON a.s != b.s AND 5 * len(list_intersect(a.g, b.g)) > 2 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))),
r(a, b) AS (SELECT s, s FROM t UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT t.s AS name, t.n AS rows, (SELECT count(*) FROM p WHERE p.a = t.s) AS links, (SELECT min(b) FROM r WHERE r.a = t.s) AS class FROM t
""")
def op_name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names whose trigrams are alike (Jaccard similarity above 0.4): the links and the class of each name, by a prefix-filtered equi-join."""
    return similarity.similar_classes(table(spark, sf_dir, "part"), "p_name")


@query("SELECT e.event_id, t.n FROM events e LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE event_type != 'error' GROUP BY event_type) t ON e.event_type = t.event_type")
def op_salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the size of its type: five keys hold all rows, so each is spread."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    sizes = e.filter("event_type != 'error'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return skew.salted_join(e, sizes, ["event_type"], "left", least=1000).select("event_id", "n")


@query("""
SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal >= 0 AND s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0
""")
def op_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select("s_suppkey", "s_nationkey")
    new = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"))
    return skew.upsert(old, new, "s_suppkey")


@query("SELECT o_orderkey FROM orders WHERE md5(CAST(o_orderkey AS VARCHAR)) < '20'")
def op_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An eighth of the orders, the same at every run and on every cluster: by hash, without a shuffle."""
    return table(spark, sf_dir, "orders").select("o_orderkey").filter(F.md5(F.col("o_orderkey").cast("string").cast("binary")) < "20")


@query("""
SELECT l.doc_id, count(r.doc_id) AS n, CAST(coalesce(sum(r.n_chars), 0) AS BIGINT) AS total
FROM (SELECT * FROM documents WHERE lang = 'en') l LEFT JOIN (SELECT * FROM documents WHERE lang = 'de') r ON r.doc_id < l.doc_id AND r.n_chars >= l.n_chars
GROUP BY l.doc_id
""")
def op_inequality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each English document, how many earlier German ones are as long or longer, and their characters: two inequalities and no equality."""
    d = table(spark, sf_dir, "documents")
    asking = d.filter("lang = 'en'").select("doc_id", "n_chars")
    others = d.filter("lang = 'de'").select(F.col("doc_id").alias("earlier"), F.col("n_chars").alias("size"))
    return ordered.inequality_sums(asking, others, [("doc_id", ">", "earlier"), ("n_chars", "<=", "size")], "size").select("doc_id", "n", "total")


@query("""
SELECT doc_id, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist,
  CAST(ntile(4) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INT) AS quarter
FROM documents WINDOW w AS (PARTITION BY lang ORDER BY source)
""")
def op_group_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of documents within four languages, by a column of twenty values and by one of many; no task holds a language or a source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    tied = ordered.ranks(d, ["lang"], {"source": True})
    single = ordered.ranks(d, ["lang"], {"n_chars": False, "doc_id": True})
    share = lambda name: F.round(name, 6).alias(name)
    return tied.select("doc_id", "rank", "dense_rank", share("percent_rank"), share("cume_dist")).join(single.select("doc_id", ordered.ntile(4).alias("quarter")), "doc_id")


SHARES = [0.01, 0.25, 0.5, 0.9, 0.99]


@query(f"""
SELECT source, lang, unnest({SHARES}::DOUBLE[]) AS share, round(unnest(quantile_cont(CAST(n_chars AS DOUBLE), {SHARES})), 4) AS percentile FROM documents GROUP BY source, lang
""")
def op_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five exact percentiles of the lengths of each source's and language's documents in one pass."""
    return ordered.percentiles(table(spark, sf_dir, "documents"), ["source", "lang"], "n_chars", SHARES).withColumn("percentile", F.round("percentile", 4))


@query("""
WITH t AS (SELECT l_partkey, l_suppkey, s_nationkey, n_regionkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT 'supplier' AS level, CAST(l_suppkey AS BIGINT) AS key, count(DISTINCT l_partkey) AS parts FROM t GROUP BY l_suppkey
UNION ALL SELECT 'nation', CAST(s_nationkey AS BIGINT), count(DISTINCT l_partkey) FROM t GROUP BY s_nationkey
UNION ALL SELECT 'region', CAST(n_regionkey AS BIGINT), count(DISTINCT l_partkey) FROM t GROUP BY n_regionkey
UNION ALL SELECT 'all', CAST(NULL AS BIGINT), count(DISTINCT l_partkey) FROM t
""")
def op_bitmap_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of suppliers, nations, regions and in all from one scan of the line items; the coarser levels only merge bitmaps."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = place.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("nation"), F.col("n_regionkey").cast("long").alias("region"))
    return sketches.distinct_by_level(line, place, "l_suppkey", "l_partkey", ["nation", "region"]).select(F.when(F.col("level") == "l_suppkey", "supplier").otherwise(F.col("level")).alias("level"), "key", F.col("n").alias("parts"))


@query()
def op_quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of each supplier's prices from KLL sketches of each year, stored and merged later; their rank error is tested."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_extendedprice")
    stored = sketches.store_quantiles(line, ["l_suppkey", "year"], "l_extendedprice")
    return sketches.merged_quantiles(spark, stored, ["l_suppkey"], [0.25, 0.5, 0.75])


@query("""
WITH t AS (SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag != 'R') AS o FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) FILTER (WHERE r) AS returned, count(*) FILTER (WHERE o) AS kept, count(*) FILTER (WHERE r AND o) AS both, count(*) FILTER (WHERE o AND NOT r) AS never_returned, count(*) AS parts FROM t GROUP BY l_suppkey
""")
def op_sketch_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each supplier that have been returned, kept, both, or never returned, from theta sketches (exact up to 4,096 parts, estimates beyond)."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").alias("r"))
    return sketches.set_counts(line, ["l_suppkey"], "l_partkey", "r").select(
        "l_suppkey", F.col("yes").alias("returned"), F.col("no").alias("kept"), "both", F.col("only_no").alias("never_returned"), F.col("either").alias("parts")
    )


@query("SELECT c_custkey, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def op_pruned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, laid out by nation, of one region: which nations these are is known at run time only, and no other folder is read."""
    c = pruning.partitioned(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_nationkey")
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select("n_nationkey", "n_name")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "n_name")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_totalprice > 400000")
def op_filtered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of few orders: a Bloom filter of these orders meets the lines before their shuffle, where the scan is large enough to repay it."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 400000").select("o_orderkey")
    return pruning.filtered_join(line, o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")
