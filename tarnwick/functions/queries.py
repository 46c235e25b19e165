"""Scalar, date, array and JSON functions, and the UDF surface."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tarnwick.registry import query, sql_query
from tarnwick.sources.tables import table

sql_query("f_strings", "SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n, upper(c_mktsegment) AS u, lower(c_name) AS l, substr(c_name, 2, 4) AS s, concat(c_name, '/', c_mktsegment) AS c, replace(c_name, '0', 'o') AS r, lpad(c_mktsegment, 12, '*') AS p, trim(concat(' ', c_name, ' ')) AS t, reverse(c_name) AS v, md5(c_name) AS m FROM {customer}")
sql_query("f_split", "SELECT doc_id, size(split(text, ' ')) AS n FROM {documents}", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS n FROM documents")
sql_query("f_regexp", "SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_replace(url, '[0-9]+', '#') AS masked FROM {pages}", "SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_replace(url, '[0-9]+', '#', 'g') AS masked FROM pages")
sql_query("f_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM {orders}")
sql_query("f_date_difference", "SELECT o_orderkey, datediff(DAY, o_orderdate, TIMESTAMP_NTZ '2002-01-01') AS days, o_orderdate + INTERVAL '3' DAY AS later FROM {orders}", "SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS days, o_orderdate + INTERVAL 3 DAY AS later FROM orders")
sql_query("f_math", "SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, greatest(p_size, 10) AS g, least(p_size, 10) AS w, sign(p_size - 25) AS i FROM {part}", "SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, greatest(p_size, 10) AS g, least(p_size, 10) AS w, CAST(sign(p_size - 25) AS DOUBLE) AS i FROM part")
sql_query("f_safe_divide", "SELECT p_partkey, try_divide(CAST(p_size AS DOUBLE), p_size % 3) AS q FROM {part}", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / (p_size % 3) END AS q FROM part")
sql_query("f_conditional", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal > 9000 THEN 'rich' ELSE 'fine' END AS k, coalesce(nullif(c_nationkey, 3), -1) AS n FROM {customer}")
sql_query("f_casts", "SELECT p_partkey, CAST(p_size AS STRING) AS s, CAST(CAST(p_size AS STRING) AS BIGINT) AS b, try_cast(p_brand AS INT) AS t FROM {part}")
sql_query("f_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql_query("f_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql_query("f_array_fold", "SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE)), 0D, (s, x) -> s + x * x), 6) AS norm FROM {embeddings}", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm FROM embeddings")
sql_query("f_explode", "SELECT label, i, count(*) AS n FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS i, v WHERE v > 0 GROUP BY label, i", "SELECT label, CAST(i AS INT) AS i, count(*) AS n FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) WHERE v > 0 GROUP BY label, i")
sql_query("f_hash", "SELECT doc_id, sha2(text, 256) AS h FROM {documents}", "SELECT doc_id, sha256(text) AS h FROM documents")
sql_query("f_strings_more", "SELECT c_custkey, CAST(instr(c_name, '#') AS BIGINT) AS i, repeat(c_mktsegment, 2) AS r, left(c_name, 3) AS l, right(c_name, 3) AS e, rpad(c_mktsegment, 12, '.') AS p, translate(c_name, '012', 'abc') AS t, concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING')) AS w, CAST(levenshtein(c_name, c_mktsegment) AS BIGINT) AS d, ascii(c_name) AS a FROM {customer}")
sql_query("f_string_tests", "SELECT p_partkey, startswith(p_name, 's') AS s, endswith(p_name, 'g') AS e, contains(p_name, 'ol') AS c, p_type ILIKE 'small%' AS i FROM {part}", "SELECT p_partkey, starts_with(p_name, 's') AS s, ends_with(p_name, 'g') AS e, contains(p_name, 'ol') AS c, p_type ILIKE 'small%' AS i FROM part")
sql_query("f_encodings", "SELECT c_custkey, hex(c_name) AS h, base64(CAST(c_name AS BINARY)) AS b, CAST(unhex(hex(c_name)) AS STRING) AS u, bin(c_custkey) AS n FROM {customer}", "SELECT c_custkey, hex(c_name) AS h, base64(encode(c_name)) AS b, decode(unhex(hex(c_name))) AS u, bin(c_custkey) AS n FROM customer")
sql_query("f_bits", "SELECT p_partkey, p_size & 6 AS a, p_size | 6 AS o, p_size ^ 6 AS x, shiftleft(p_size, 2) AS l, shiftright(p_size, 1) AS r, CAST(bit_count(p_size) AS INT) AS c FROM {part}", "SELECT p_partkey, p_size & 6 AS a, p_size | 6 AS o, xor(p_size, 6) AS x, p_size << 2 AS l, p_size >> 1 AS r, CAST(bit_count(p_size) AS INT) AS c FROM part")
sql_query("f_dates_more", "SELECT o_orderkey, last_day(o_orderdate) AS l, date_format(o_orderdate, 'yyyy-MM') AS f, CAST(dayofyear(o_orderdate) AS BIGINT) AS y, CAST(weekofyear(o_orderdate) AS BIGINT) AS w, add_months(o_orderdate, 1) AS a, make_date(year(o_orderdate), 1, 1) AS j, CAST(dayofweek(o_orderdate) AS BIGINT) AS d FROM {orders}", "SELECT o_orderkey, last_day(o_orderdate) AS l, strftime(o_orderdate, '%Y-%m') AS f, dayofyear(o_orderdate) AS y, weekofyear(o_orderdate) AS w, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS a, make_date(year(o_orderdate), 1, 1) AS j, dayofweek(o_orderdate) + 1 AS d FROM orders")
sql_query("f_date_parsing", "SELECT o_orderkey, to_date(date_format(o_orderdate, 'dd/MM/yyyy'), 'dd/MM/yyyy') AS d, try_cast(concat(o_orderstatus, '1') AS DATE) AS none FROM {orders}", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, try_cast(concat(o_orderstatus, '1') AS DATE) AS none FROM orders")
sql_query("f_math_more", "SELECT p_partkey, round(pow(p_size, 1.5D), 4) AS p, round(exp(p_size / 50.0D), 6) AS e, round(log10(p_retailprice), 6) AS l, round(cbrt(p_retailprice), 6) AS c, round(sin(p_size), 6) AS s, round(atan2(p_size, 3), 6) AS a, round(degrees(p_size / 10.0D), 4) AS g FROM {part}", "SELECT p_partkey, round(pow(p_size, 1.5), 4) AS p, round(exp(CAST(p_size AS DOUBLE) / 50.0), 6) AS e, round(log10(p_retailprice), 6) AS l, round(cbrt(p_retailprice), 6) AS c, round(sin(p_size), 6) AS s, round(atan2(p_size, 3), 6) AS a, round(degrees(CAST(p_size AS DOUBLE) / 10.0), 4) AS g FROM part")
sql_query("f_arrays", "SELECT vec_id, size(filter(embedding, x -> x > 0)) AS pos, exists(embedding, x -> x > 0.4) AS big, forall(embedding, x -> abs(x) <= 1) AS unit, round(CAST(array_max(embedding) AS DOUBLE), 6) AS hi, array_contains(transform(embedding, x -> x < -0.3), true) AS neg FROM {embeddings}", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS pos, len(list_filter(embedding, lambda x: x > 0.4)) > 0 AS big, len(list_filter(embedding, lambda x: abs(x) > 1)) = 0 AS unit, round(CAST(list_max(embedding) AS DOUBLE), 6) AS hi, list_contains(list_transform(embedding, lambda x: x < -0.3), true) AS neg FROM embeddings")
sql_query("f_array_sets", "SELECT doc_id, size(array_distinct(w)) AS d, md5(array_join(sort_array(array_distinct(w)), ' ')) AS s, size(array_intersect(w, array('the', 'der', 'la'))) AS i, size(array_except(array('the', 'der', 'la'), w)) AS x FROM (SELECT doc_id, split(text, ' ') AS w FROM {documents}) t", "SELECT doc_id, CAST(len(list_distinct(w)) AS INT) AS d, md5(array_to_string(list_sort(list_distinct(w)), ' ')) AS s, CAST(len(list_intersect(list_distinct(w), ['the', 'der', 'la'])) AS INT) AS i, CAST(3 - len(list_intersect(['the', 'der', 'la'], w)) AS INT) AS x FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) t")
sql_query("f_maps", "SELECT n_nationkey, element_at(m, 'a') AS a, try_element_at(m, 'zz') AS none, size(map_filter(m, (k, v) -> v > 10)) AS big, array_join(map_keys(m), ',') AS k FROM (SELECT n_nationkey, map('a', n_nationkey, 'b', n_regionkey * 6) AS m FROM {nation}) t", "SELECT n_nationkey, n_nationkey AS a, CAST(NULL AS INT) AS none, CAST(n_nationkey > 10 AS INT) + CAST(n_regionkey * 6 > 10 AS INT) AS big, 'a,b' AS k FROM nation")
sql_query("f_structs", "SELECT c_custkey, t.s.name AS name, t.s.more.balance AS balance FROM (SELECT c_custkey, named_struct('name', c_name, 'more', named_struct('balance', c_acctbal)) AS s FROM {customer}) t", "SELECT c_custkey, c_name AS name, c_acctbal AS balance FROM customer")
sql_query("f_json_schema", "SELECT event_id, from_json(props, 'k BIGINT, absent STRING').k AS k, from_json(props, 'k BIGINT, absent STRING').absent AS absent, to_json(named_struct('id', event_id, 'type', event_type)) AS j FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent, CAST(json_object('id', event_id, 'type', event_type) AS VARCHAR) AS j FROM events")
sql_query("f_nulls", "SELECT p_partkey, nvl(nullif(p_size, 7), -1) AS a, nvl2(nullif(p_size, 7), 1, 0) AS b, ifnull(nullif(p_brand, 'Brand#1'), 'none') AS c, nullif(p_size, 7) IS NULL AS d, nullif(p_size, 7) <=> NULL AS e FROM {part}", "SELECT p_partkey, coalesce(nullif(p_size, 7), -1) AS a, CASE WHEN p_size = 7 THEN 0 ELSE 1 END AS b, ifnull(nullif(p_brand, 'Brand#1'), 'none') AS c, p_size = 7 AS d, p_size = 7 AS e FROM part")
sql_query("f_sequences", "SELECT n_nationkey, d FROM {nation} LATERAL VIEW explode(sequence(DATE '2024-01-01', date_add(DATE '2024-01-01', n_regionkey), INTERVAL '1' DAY)) t AS d", "SELECT n_nationkey, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-01' + n_regionkey, INTERVAL 1 DAY)) AS DATE) AS d FROM nation")
sql_query("f_url_parts", "SELECT page_id, parse_url(url, 'PROTOCOL') AS scheme, url_encode(CAST(page_id AS STRING)) AS e FROM {pages}", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, CAST(page_id AS VARCHAR) AS e FROM pages")


@pandas_udf(DoubleType())
def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
    return (price * (1 - discount)).round(6)


@pandas_udf(DoubleType())
def lowest(v: pd.Series) -> float:
    """An aggregate of a group that fits a batch."""
    return float(v.min())


@pandas_udf(DoubleType())
def highest(v: pd.Series) -> float:
    return float(v.max())


def _part(key: str):
    """A part of a group, of about as many rows however large the group is, if keys are dense."""
    return F.floor(F.col(key) / 1000).alias("part")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS d FROM lineitem")
def u_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(discounted("l_extendedprice", "l_discount"), 4).alias("d"))


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS s FROM customer GROUP BY c_nationkey")
def u_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python aggregates parts of bounded size; built-in functions merge them."""
    parts = table(spark, sf_dir, "customer").groupBy("c_nationkey", _part("c_custkey")).agg(lowest("c_acctbal").alias("low"), highest("c_acctbal").alias("high"))
    return parts.groupBy("c_nationkey").agg(F.round(F.max("high") - F.min("low"), 4).alias("s"))


@query("SELECT s_nationkey, s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS d FROM supplier")
def u_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean comes from built-in functions; Python sees parts of bounded size, and no column that it does not need."""

    def centred(g: pd.DataFrame) -> pd.DataFrame:
        return g[["s_nationkey", "s_suppkey"]].assign(d=(g["s_acctbal"] - g["mean"]).round(4))

    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    rows = s.join(s.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("mean")), "s_nationkey")
    return rows.groupBy("s_nationkey", _part("s_suppkey")).applyInPandas(centred, "s_nationkey int, s_suppkey long, d double")


@query("SELECT p_partkey, p_size * 2 AS twice FROM part WHERE p_size > 10")
def u_map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["p_size"] > 10]
            yield pd.DataFrame({"p_partkey": b["p_partkey"], "twice": b["p_size"] * 2})

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, twice int")


@query("SELECT n_nationkey, CAST(unnest(range(0, n_nationkey % 4)) AS INT) AS i FROM nation")
def u_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Numbers:
        def eval(self, n: int):
            for i in range(n % 4):
                yield (i,)

    spark.udtf.register("tarnwick_numbers", F.udtf(Numbers, returnType="i int"))
    return spark.sql("SELECT n_nationkey, i FROM {nation}, LATERAL tarnwick_numbers(n_nationkey)", nation=table(spark, sf_dir, "nation"))


@F.udf(returnType=StringType(), useArrow=True)
def _initials(name: str, segment: str) -> str:
    return f"{name[:1]}{segment[:1]}"


@query("SELECT c_custkey, substr(c_name, 1, 1) || substr(c_mktsegment, 1, 1) AS i FROM customer")
def u_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row by row in Python, carried by Arrow; for logic that no built-in function has."""
    return table(spark, sf_dir, "customer").select("c_custkey", _initials("c_name", "c_mktsegment").alias("i"))


@pandas_udf(DoubleType())
def _scaled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """An iterator of batches: what is set up before the loop is set up once a task."""
    factor = 0.5
    for b in batches:
        yield b * factor


@query("SELECT p_partkey, round(p_retailprice * 0.5, 4) AS h FROM part")
def u_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(_scaled("p_retailprice"), 4).alias("h"))


@query("SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n FROM part")
def u_map_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.utf8_length(b.column(1)).cast(pa.int64())], ["p_partkey", "n"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_name").mapInArrow(run, "p_partkey long, n long")


@query("SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def u_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of two tables' groups of a key side by side, of bounded size; only the keys cross the shuffle."""

    def sizes(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), _part("c_custkey")).groupBy("k", "part")
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), _part("s_suppkey")).groupBy("k", "part")
    parts = a.cogroup(b).applyInPandas(sizes, "k int, customers long, suppliers long")
    return parts.groupBy("k").agg(F.sum("customers").alias("customers"), F.sum("suppliers").alias("suppliers"))


class Since:
    """For each row of the kind `mark`, how many of the kind `counted` came since the last one; a row a time, in the order that the call gives."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, kind: AnalyzeArgument, counted: AnalyzeArgument, mark: AnalyzeArgument) -> AnalyzeResult:
        """The key column of the result has the type that it has in the table; its name, and that of the count, follow from the arguments."""
        for a in (key, kind, counted, mark):
            if not a.isConstantExpression or not isinstance(a.value, str):
                raise ValueError("names of columns and kinds must be constant strings")
        return AnalyzeResult(StructType([StructField(key.value, rows.dataType[key.value].dataType), StructField(f"n_{counted.value}", LongType())]))

    def __init__(self):
        self.n = 0

    def eval(self, rows: Row, key: str, kind: str, counted: str, mark: str):
        if rows[kind] == mark:
            yield rows[key], self.n
            self.n = 0
        elif rows[kind] == counted:
            self.n += 1


@query("""
WITH k AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events)
SELECT p.event_id, count(c.event_id) AS n_click FROM (SELECT * FROM k WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM k WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.g = c.g
GROUP BY p.event_id
""")
def u_table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks before each purchase since the user's last: one pass over a table by user and time, one number as state, however many events a user has."""
    spark.udtf.register("tarnwick_since", F.udtf(Since))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    call = "SELECT event_id, n_click FROM tarnwick_since(TABLE({rows}) PARTITION BY user_id ORDER BY (ts, event_id), 'event_id', 'event_type', 'click', 'purchase')"
    return spark.sql(call, rows=rows)
