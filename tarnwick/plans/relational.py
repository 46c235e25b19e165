"""Relational plans on the star schema: joins, aggregates, windows, set operations, CTEs.

Money is summed as decimals, so results do not depend on the order of addition.
Small dimensions (nation, region) are left to Catalyst, which broadcasts them by
their measured size; larger joins are adaptive and split skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators import ordered, skew, temporal
from tarnwick.registry import query, sql_query
from tarnwick.sources.tables import table

REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE)"


def _money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query(f"""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, {REVENUE} AS revenue,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def q_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(_money("l_quantity").alias("sum_qty"), F.expr(REVENUE).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-02-01' AND l_discount BETWEEN 0.05 AND 0.07")
def q_filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").filter((c("l_shipdate") >= "1997-01-01") & (c("l_shipdate") < "1997-02-01") & c("l_discount").between(0.05, 0.07)).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_type, '^[A-Z]') AND p_brand LIKE '%1%' AND p_size IN (1, 5, 9, 15)")
def q_filter_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_type").rlike("^[A-Z]") & F.col("p_brand").like("%1%") & F.col("p_size").isin(1, 5, 9, 15)).select("p_partkey", "p_name")


@query(f"""
SELECT n_name, {REVENUE} AS revenue, count(DISTINCT o_orderkey) AS n_orders
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name
""")
def q_join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, *c: table(spark, sf_dir, n).select(*c)
    rows = t("lineitem", "l_orderkey", "l_extendedprice", "l_discount").join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.expr(REVENUE).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 GROUP BY o_orderkey")
def q_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The larger side is counted before it meets the orders: one row a key crosses the join.
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def q_join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")), "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


sql_query("q_join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("q_join_cross", "SELECT r_name, s.l_linestatus AS status FROM {region} CROSS JOIN (SELECT DISTINCT l_linestatus FROM {lineitem}) s")
sql_query("q_join_right", "SELECT s_suppkey, n_name FROM {nation} RIGHT JOIN {supplier} ON n_nationkey = s_nationkey AND n_regionkey = 2")
sql_query("q_join_using", "SELECT o_orderkey, n FROM (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P') a JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) b USING (o_orderkey)")
sql_query(
    "q_join_null_safe",
    # Suppliers are counted before they meet the customers: one row a key crosses the join.
    "SELECT a.c_custkey, sum(b.n) AS n FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer}) a JOIN (SELECT nullif(s_nationkey, 3) AS k, count(*) AS n FROM {supplier} GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.c_custkey",
    "SELECT a.c_custkey, count(*) AS n FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.c_custkey",
)
sql_query("q_subquery_any", "SELECT n_name, (SELECT max(c_acctbal) FROM {customer} WHERE c_nationkey = n_nationkey) AS top FROM {nation} WHERE n_nationkey = ANY (SELECT s_nationkey FROM {supplier})".replace("= ANY", "IN"))
sql_query("q_subquery_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 50) AND p_size > 40")
sql_query("q_subquery_not_in", "SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)")
sql_query("q_subquery_exists", "SELECT s_suppkey FROM {supplier} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_discount = 0.1 AND l_quantity > 48)")
sql_query(
    "q_subquery_scalar",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} l WHERE l_quantity > (SELECT 1.9 * avg(l_quantity) FROM {lineitem} i WHERE i.l_partkey = l.l_partkey)",
)
sql_query(
    "q_lateral_top",
    "SELECT n_name, c_custkey, c_acctbal FROM {nation}, LATERAL (SELECT c_custkey, c_acctbal FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3) t",
)
sql_query(
    "q_cte",
    "WITH t AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), m AS (SELECT max(n) AS top FROM t) SELECT o_custkey, n FROM t JOIN m ON n >= top - 1",
)
sql_query("q_cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql_query("q_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql_query("q_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n, grouping(c_nationkey) AS g FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)".replace("grouping(c_nationkey)", "CAST(grouping(c_nationkey) AS INT)"))
sql_query("q_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql_query("q_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 14")
sql_query("q_filter_clause", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) AS n FROM {orders} GROUP BY o_orderpriority")
sql_query("q_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 5) AS sd, round(var_pop(l_quantity), 4) AS vp, round(corr(l_quantity, l_extendedprice), 5) AS r FROM {lineitem} GROUP BY l_returnflag")
sql_query("q_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(covar_pop(l_quantity, l_discount), 6) AS cov FROM {lineitem} GROUP BY l_returnflag")
sql_query("q_moments", "SELECT c_mktsegment, round(skewness(c_acctbal), 4) AS s, round(stddev_pop(c_acctbal), 3) AS p, round(var_samp(c_acctbal / 1000), 4) AS v FROM {customer} GROUP BY c_mktsegment", "SELECT c_mktsegment, round(skewness(c_acctbal) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 4) AS s, round(stddev_pop(c_acctbal), 3) AS p, round(var_samp(c_acctbal / 1000), 4) AS v FROM customer GROUP BY c_mktsegment")
sql_query("q_logical_aggregates", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_orderstatus = 'P') AS any_one, bit_or(o_orderkey) AS bits, bit_xor(o_custkey) AS x FROM {orders} GROUP BY o_orderpriority")
sql_query("q_histogram", "SELECT CAST(floor(o_totalprice / 25000) AS INT) AS bin, count(*) AS n FROM {orders} GROUP BY 1")
sql_query("q_distinct_count", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM {lineitem} GROUP BY l_suppkey")
sql_query("q_min_max_by", "SELECT c_nationkey, max_by(c_custkey, c_acctbal * 1000000 + c_custkey) AS richest FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_custkey, c_acctbal * 1000000 + c_custkey) AS richest FROM customer GROUP BY c_nationkey")
sql_query(
    "q_collect_sorted",
    "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
sql_query(
    "q_string_aggregate",
    "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_nationkey DESC) AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey",
)
sql_query(
    "q_pivot",
    "SELECT * FROM (SELECT c_mktsegment, c_nationkey FROM {customer} WHERE c_nationkey < 3) PIVOT (count(*) FOR c_nationkey IN (0 AS n0, 1 AS n1, 2 AS n2))",
    "SELECT c_mktsegment, nullif(count(*) FILTER (WHERE c_nationkey = 0), 0) AS n0, nullif(count(*) FILTER (WHERE c_nationkey = 1), 0) AS n1, nullif(count(*) FILTER (WHERE c_nationkey = 2), 0) AS n2 FROM customer WHERE c_nationkey < 3 GROUP BY c_mktsegment",
)
sql_query(
    "q_unpivot",
    "SELECT s_suppkey, name, v FROM (SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS nation, s_suppkey % 7 AS week FROM {supplier}) UNPIVOT (v FOR name IN (nation, week))",
    "SELECT s_suppkey, 'nation' AS name, CAST(s_nationkey AS BIGINT) AS v FROM supplier UNION ALL SELECT s_suppkey, 'week', s_suppkey % 7 FROM supplier",
)
sql_query(
    "q_window_rank",
    "SELECT c_custkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INT) AS q, round(percent_rank() OVER w, 6) AS p FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)",
)
sql_query(
    "q_window_offset",
    "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS prev, lead(o_orderkey, 2, -1) OVER w AS later, first_value(o_orderkey) OVER w AS f FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
sql_query("q_window_rows", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {events}")
sql_query("q_window_share", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS share FROM {supplier}")
sql_query("q_gaps_and_islands", "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM {events}) t GROUP BY user_id, event_type, g")
sql_query("q_distinct_on", "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM {events}) t WHERE r = 1", "SELECT DISTINCT ON (user_id) user_id, event_id, value FROM events ORDER BY user_id, value DESC, event_id")
sql_query("q_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql_query("q_union_all", "SELECT c_nationkey AS k, 'c' AS t FROM {customer} UNION ALL SELECT s_nationkey, 's' FROM {supplier}")
sql_query("q_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
sql_query("q_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
sql_query("q_intersect", "SELECT o_orderkey AS k FROM {orders} INTERSECT SELECT l_orderkey FROM {lineitem}")
sql_query("q_except", "SELECT o_orderkey AS k FROM {orders} EXCEPT SELECT l_orderkey FROM {lineitem}")
sql_query("q_order_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
sql_query("q_offset", "SELECT p_partkey FROM {part} ORDER BY p_partkey LIMIT 10 OFFSET 20")
sql_query("q_values", "SELECT a, b FROM VALUES (1, 'x'), (2, NULL) AS t(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL)) AS t(a, b)")
sql_query("q_null_logic", "SELECT count(*) AS n, count(v) AS nv, sum(CASE WHEN v IS DISTINCT FROM 3 THEN 1 ELSE 0 END) AS d FROM (SELECT nullif(p_size, 7) AS v FROM {part})", "SELECT count(*) AS n, count(v) AS nv, CAST(sum(CASE WHEN v IS DISTINCT FROM 3 THEN 1 ELSE 0 END) AS BIGINT) AS d FROM (SELECT nullif(p_size, 7) AS v FROM part)")
sql_query(
    "q_pipe_syntax",
    "FROM {orders} |> WHERE o_orderstatus = 'P' |> AGGREGATE count(*) AS n GROUP BY o_orderpriority |> WHERE n > 1",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderpriority HAVING count(*) > 1",
)


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def q_window_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Five types hold all events, so they are sorted hour by hour.
    return temporal.recent_count(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts").select("event_id", "n")


@query("SELECT c_custkey, round(cume_dist() OVER w, 6) AS share, nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)")
def q_window_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 25 nations hold all customers: ranks from prefix sums, and the second of each nation from its place.
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    shares = ordered.ranks(c, ["c_nationkey"], {"c_acctbal": True}).select("c_custkey", "c_nationkey", F.round("cume_dist", 6).alias("share"))
    second = ordered.ranks(c, ["c_nationkey"], {"c_acctbal": True, "c_custkey": True}).filter("rank = 2").select("c_nationkey", F.col("c_custkey").alias("second"))
    return shares.join(second, "c_nationkey", "left").select("c_custkey", "share", "second")


@query("SELECT c_mktsegment, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal), 4) AS med FROM customer GROUP BY c_mktsegment")
def q_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Five segments hold all customers; values are counted, then dealt to ranges.
    return ordered.percentiles(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", [0.5]).select("c_mktsegment", F.round("percentile", 4).alias("med"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def q_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    # row_number() <= k is limited within each partition before the shuffle.
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= 2").drop("r")


def _hinted(hint: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        return o.join(c.hint(hint), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = f"q_join_hint_{hint}"
    return run


for _hint in ("merge", "shuffle_hash"):
    query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")(_hinted(_hint))


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def q_join_hint_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller side is sent to all only after its rows have been counted."""
    o, c = table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(skew.broadcast_small(c), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
