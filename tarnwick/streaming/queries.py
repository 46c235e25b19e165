"""Streams: each query replays `events` as a file stream to the end and returns what its sink holds.

Files go to Parquet sinks in the shared folder; state lives in checkpoints
there.  Append-mode windows appear once the watermark (the latest event less
the delay) has passed their end, which is what the oracles say in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwick.registry import query
from tarnwick.sources.tables import scratch, table

CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def stream(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """events as a stream in event time (the column ts as a timestamp, watermarked)."""
    schema = table(spark, sf_dir, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/events.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        rows = reader.parquet(path.toString())
    else:  # a stream reads folders; of this one's files only the table's own belong to it
        rows = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a query has written once its source is read to the end."""
    spark = df.sparkSession
    out, state = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state)
    if mode == "append":
        q = writer.format("parquet").start(out)
    else:
        q = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query(f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= {CLOSED}")
def st_tumbling_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stream(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return _plain(drained(w.select(F.col("w.start").alias("start"), "event_type", "n"), "tumbling"))


@query(f"""
WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events)
SELECT start, count(*) AS n FROM w GROUP BY start HAVING start + INTERVAL 1 HOUR <= {CLOSED}
""")
def st_sliding_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stream(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return _plain(drained(w.select(F.col("w.start").alias("start"), "n"), "sliding"))


@query(f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}
""")
def st_session_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stream(spark, sf_dir).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return _plain(drained(w.select("user_id", F.col("w.start").alias("start"), "n"), "session"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY event_type")
def st_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
    return drained(w, "complete", "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def st_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir, "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return drained(rows.select("user_id", "event_type"), "dedup")


@query("""
SELECT c.event_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id
WHERE c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR
""")
def st_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = stream(spark, sf_dir).filter("event_type = 'click'").select("event_id", "user_id", "ts").alias("c")
    bought = stream(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts")).alias("p")
    pairs = clicks.join(bought, F.expr("user_id = p_user AND p_ts >= ts AND p_ts <= ts + INTERVAL 1 HOUR"))
    return drained(pairs.select("event_id", "purchase_id"), "stream-join")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st_memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink in the driver's memory: for small results, five rows here."""
    name = "tarnwick_" + uuid.uuid4().hex
    counts = stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def st_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: each batch appends the counts that changed; the largest is the latest."""
    out, state = scratch(spark, "update-out"), scratch(spark, "update-state")
    counts = stream(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    # A batch that runs again writes its own folder again, so nothing is counted twice.
    put = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
    counts.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/*").groupBy("user_id").agg(F.max("n").alias("n"))


@query("SELECT c.event_id, u.c_name FROM events c JOIN customer u ON c.user_id = u.c_custkey WHERE c.event_type = 'signup'")
def st_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir).filter("event_type = 'signup'").join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    return drained(rows.select("event_id", "c_name"), "static-join")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def st_custom_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running count per user in state of its own; the last count that each user reached."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    rows = stream(spark, sf_dir).select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(count, "user_id long, n long", "n long", "append", GroupStateTimeout.NoTimeout)
    return drained(rows, "custom-state").groupBy("user_id").agg(F.max("n").alias("n"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS latest FROM events GROUP BY user_id HAVING count(*) >= 3")
def st_state_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with three events or more, by a stateful processor with typed state; the last row that each user reached."""
    from pyspark.sql.streaming import StatefulProcessor

    class Busy(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", "n long, latest long")

        def handleInputRows(self, key, rows, timerValues):
            n, latest = self.seen.get() if self.seen.exists() else (0, -1)
            for f in rows:
                n, latest = n + len(f), max(latest, int(f["event_id"].max()))
            self.seen.update((n, latest))
            if n >= 3:
                yield pd.DataFrame({"user_id": [key[0]], "n": [n], "latest": [latest]})

        def close(self) -> None:
            pass

    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        rows = stream(spark, sf_dir).select("user_id", "event_id").groupBy("user_id").transformWithStateInPandas(Busy(), "user_id long, n long, latest long", "append", "none")
        out = drained(rows, "state-processor")
    finally:
        spark.conf.set(key, before)
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max("latest").alias("latest"))
