"""Sources and sinks: file formats, partitioned layouts and a source written in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnwick.registry import query
from tarnwick.sources.tables import scratch, table

NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def through(spark: SparkSession, sf_dir: str, name: str, format: str, **options) -> DataFrame:
    """A table written in a format and read again with its schema given (nothing is inferred)."""
    df, path = table(spark, sf_dir, name), scratch(spark, format)
    df.write.format(format).options(**options).save(path)
    return spark.read.format(format).schema(df.schema).options(**options).load(path)


@query(NATION)
def s_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "nation", "csv", header="true")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "customer", "json")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def s_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "part", "orc")


@query("SELECT n_name AS value FROM nation")
def s_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "text")
    table(spark, sf_dir, "nation").select("n_name").write.text(path)
    return spark.read.text(path)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def s_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout partitioned by status: the filter reads one folder only."""
    path = scratch(spark, "partitioned")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).filter("o_orderstatus = 'P'")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "supplier", "xml", rowTag="row")


@query("SELECT r_regionkey, r_name FROM region")
def s_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "region", "csv", header="true", sep="|", compression="gzip")


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN n_name END AS n_name, CASE WHEN n_regionkey >= 2 THEN n_regionkey END AS n_regionkey FROM nation")
def s_merged_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of different columns in one folder: the schemas are merged and what a file lacks is null."""
    path, n = scratch(spark, "merged"), table(spark, sf_dir, "nation")
    n.filter("n_regionkey < 2").select("n_nationkey", "n_name").write.parquet(path)
    n.filter("n_regionkey >= 2").select("n_nationkey", "n_regionkey").write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", "true").parquet(path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def s_overwritten_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition written anew, the others kept."""
    path, o = scratch(spark, "overwritten"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    o.write.partitionBy("o_orderstatus").parquet(path)
    anew = o.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0))
    anew.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema(o.schema).parquet(path)


@query("SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def s_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables bucketed by order, so that their join reads bucket by bucket and shuffles neither."""
    sides = []
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        path = scratch(spark, f"bucketed-{name}")
        stored = "tarnwick_" + path.rsplit("/", 1)[1].replace("-", "_")
        table(spark, sf_dir, name).write.bucketBy(8, key).sortBy(key).option("path", path).saveAsTable(stored)
        sides.append(spark.table(stored))
        spark.sql(f"DROP TABLE {stored}")  # of the catalog only: the files are the folder's, and the plan knows them
    o, l = sides
    joined = o.join(l.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


class Steps(DataSource):
    """Numbers 0 to `rows` - 1 with their squares, in `parts` partitions; a template for sources without a Spark connector."""

    @classmethod
    def name(cls) -> str:
        return "tarnwick_steps"

    def schema(self) -> str:
        return "n long, square long"

    def reader(self, schema) -> DataSourceReader:
        options = self.options

        class Reader(DataSourceReader):
            def partitions(self):
                parts = int(options.get("parts", 4))
                return [InputPartition((i, parts)) for i in range(parts)]

            def read(self, partition):
                i, parts = partition.value
                for n in range(i, int(options.get("rows", 0)), parts):
                    yield n, n * n

        return Reader()


@query("SELECT CAST(r AS BIGINT) AS n, CAST(r * r AS BIGINT) AS square FROM range(1000) t(r)")
def s_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(Steps)
    return spark.read.format("tarnwick_steps").option("rows", 1000).load()
