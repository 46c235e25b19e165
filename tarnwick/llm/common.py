"""Shared folder, exact distributed ranks and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes of one Arrow batch (a longer row is a batch of its own): bounds the memory of a Python worker and of the JVM's buffers when texts are long.
ARROW_ROWS, ARROW_BYTES = 256, 8 << 20
_scratches: ContextVar[tuple] = ContextVar("scratches", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, the session's Arrow batches hold at most ARROW_ROWS rows and ARROW_BYTES bytes; afterwards what they held before."""
    key = "spark.sql.execution.arrow.max%sPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {k: spark.conf.get(key % k) for k in ("Records", "Bytes")}
    try:
        if not 0 < int(before["Records"]) <= ARROW_ROWS:
            spark.conf.set(key % "Records", str(ARROW_ROWS))
        if not 0 < size(before["Bytes"]) <= ARROW_BYTES:
            spark.conf.set(key % "Bytes", f"{ARROW_BYTES}b")
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(key % k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master; elsewhere that
    would be a folder of one machine, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tarnwick-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut.

    The table outlives lost executors.  It stays until the folder is cleaned,
    since results that read it are lazy, or until the scratch() around it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for held in _scratches.get():
        held.append(path)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is read in fewer tasks than these: tables of one or few files, whose texts are worth a shuffle then.  Larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete what written() wrote for these; nothing may read it afterwards."""
    for df in tables:
        delete(df.sparkSession, df._scratch)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end every table that the operators wrote within it: for callers that have written their own results by then."""
    held: list[str] = []
    token = _scratches.set((*_scratches.get(), held))
    try:
        yield
    finally:
        _scratches.reset(token)
        for path in held:
            delete(spark, path)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", salts: int = 256) -> DataFrame:
    """df with each row's exact 0-based rank among the rows of its keys.

    Rows are dealt out by keys and a hash of the order columns, so a key with a
    third of all rows is spread over `salts` sorts; ranks follow (salt, order).
    Rows equal in all order columns may swap ranks; they meet in one sort, which
    spills, so choose order columns that few rows share.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    by = [*keys, "_salt"]
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = salted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.coalesce(before, F.lit(0)).alias("_base"))
    within = salted.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return within.join(bases, by).withColumn(name, F.col("_base") + F.col("_row") - 1).drop("_salt", "_base", "_row")


def placed(df: DataFrame, order: str, name: str = "place", parts: int = 16) -> DataFrame:
    """df, written, with each row's 0-based place in the order of one column of distinct values; no task holds all rows."""
    dealt = df.repartitionByRange(parts, order).sortWithinPartitions(order)
    rows = written(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "placed")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # over `parts` rows
    bases = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_row")).drop("_part", "_row", "_base")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of (a long, b long) edges: rows (node, root), root the smallest node.

    Alternating large-star and small-star contraction; rounds grow with the
    logarithm of the longest path.  Each round is written to the shared folder
    and the one before it deleted.  Minima are pre-aggregated before shuffles,
    and no node's neighbours are collected.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        hung = e.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hung.union(low.select("a", F.col("m").alias("b"))).distinct()

    def settled(e: DataFrame) -> bool:
        """Whether every node hangs from one root that hangs from none."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(e.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up > 1 OR up = 1 AND low = 1").isEmpty()

    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    current = written(down, name)
    while not settled(current):
        nxt = written(star(star(current, True), False), name)
        discard(current)
        current = nxt
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
