"""Streams of many batches: events replayed in the order of their time, one file a batch.

State is written in one batch and read in later ones, watermarks advance from
batch to batch, and timers, evictions and late rows follow them.  Oracles say
in SQL what has been closed when the last batch is through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tarnwick.registry import query
from tarnwick.sources.tables import scratch, table

#: Files that a replay has at least, and rows of one at most (but for rows of one time, which stay together).
BATCHES, ROWS = 8, 1 << 20


def replay(df: DataFrame, time: str, batches: int = BATCHES, rows: int = ROWS) -> str:
    """Folder with df's rows in files that follow each other in `time`; a stream reads them in that order.

    File streams take the oldest file first, so the files' times of modification
    are set a second apart; a store that keeps no such times is refused.  Rows
    without a time come first.
    """
    spark = df.sparkSession
    folder = scratch(spark, "replay")
    k = max(batches, -(-df.count() // rows))
    df.repartitionByRange(k, time).sortWithinPartitions(time).write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = lambda: sorted((s for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
    files = parts()
    start = min((s.getModificationTime() for s in files), default=0) // 1000 * 1000 - 1000 * len(files)
    for i, s in enumerate(files):
        fs.setTimes(s.getPath(), start + 1000 * i, -1)
    times = [s.getModificationTime() for s in parts()]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise ValueError("the shared folder keeps no times of modification, by which a stream orders its files")
    return folder


def stream(spark: SparkSession, folder: str, schema, delay: str) -> DataFrame:
    """The replay's files, one a batch; ts as a timestamp with a watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session's setting within it; afterwards what it was before."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ran(df: DataFrame, name: str) -> tuple[DataFrame, list]:
    """What a query in append mode has written once its files are read, and the progress of its last hundred batches.

    Every batch opens and commits each part of the state.  A batch has ROWS rows
    however large the table is, so parts are no more than twice the cores.
    """
    spark = df.sparkSession
    out, state = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")
    key = "spark.sql.shuffle.partitions"
    with setting(spark, key, str(min(int(spark.conf.get(key)), 2 * spark.sparkContext.defaultParallelism))):
        q = df.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", state).format("parquet").start(out)
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out), list(q.recentProgress)


def state_store(spark: SparkSession):
    """Queries that start within it keep their state in RocksDB, which holds more than memory does and has timers and typed state."""
    return setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def windows(events: DataFrame, width: str) -> DataFrame:
    """start, event_type, n of each window of a stream."""
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def first_of_day(events: DataFrame) -> DataFrame:
    """user_id, event_type, day: each once.  The watermark's delay must be a day or more; state of a day goes when the watermark has left it."""
    days = events.withColumn("day", F.date_trunc("day", "ts"))
    return days.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


class Sessions(StatefulProcessor):
    """Sessions of users: runs of rows less than `gap` microseconds apart, with the number of rows and of different types.

    A key is a group of users, so that a batch takes few calls.  Runs wait in a
    list until they can grow no more: a timer of event time fires when the
    watermark has passed the end of one.  Rows may come in any order that the
    watermark allows; runs that they bring together become one.  The list holds
    no more than the open sessions, each with its bounds and types; it is one
    value of state, read and written once a call, as rows of state cost more
    than all else.
    """

    SCHEMA = "user_id long, start long, n long, kinds long"

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "runs binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for f in rows:
            kinds = (() if pd.isna(t) else (t,) for t in f["event_type"])
            found += [(known, user, us, us, 1, kind) for known, user, us, kind in zip(f["known"].tolist(), f["user_id"].tolist(), f["us"].tolist(), kinds, strict=True)]
        yield from self.settle(found, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle([], timerValues)

    def settle(self, found: list, timerValues) -> Iterator[pd.DataFrame]:
        """Adds the runs found, gives out the sessions that have ended, keeps the others, and sets the timer to the first end among them."""
        runs: list[list] = []
        held = self.runs.get()
        for known, user, start, last, n, kinds in sorted([*(pickle.loads(held[0]) if held else ()), *found], key=itemgetter(0, 1, 2)):
            now = runs[-1] if runs else None
            if now and now[0] == known and now[1] == user and start - now[3] < self.gap:
                now[3], now[4] = max(now[3], last), now[4] + n
                now[5].update(kinds)
            else:
                runs.append([known, user, start, last, n, set(kinds)])
        end = lambda run: -(-(run[3] + self.gap) // 1000)
        passed = timerValues.getCurrentWatermarkInMs()
        done = [run for run in runs if end(run) <= passed]
        left = [run for run in runs if end(run) > passed]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.runs.update((pickle.dumps([(*run[:5], tuple(run[5])) for run in left]),))
            self.handle.registerTimer(min(map(end, left)))
        else:
            self.runs.clear()
        if done:
            users = pd.array([run[1] if run[0] else None for run in done], "Int64")
            yield pd.DataFrame({"user_id": users, "start": [run[2] for run in done], "n": [run[4] for run in done], "kinds": [len(run[5]) for run in done]})

    def close(self) -> None:
        pass


def sessions(events: DataFrame, gap: int = 30 * 60 * 1_000_000, groups: int = 128) -> DataFrame:
    """user_id, start, n, kinds of the ended sessions of a stream with user_id, ts and event_type; state_store() must hold.

    Users are dealt to `groups` keys: a call has about that part of a batch's
    rows and of the open sessions.  Rows without a time are of no session.
    """
    user = F.coalesce(F.col("user_id").cast("long"), F.lit(0))
    rows = events.filter("ts IS NOT NULL").select(F.col("user_id").isNotNull().alias("known"), user.alias("user_id"), "event_type", "ts", F.unix_micros("ts").alias("us"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int"))
    found = dealt.groupBy("part").transformWithStateInPandas(Sessions(gap), Sessions.SCHEMA, "append", "EventTime")
    return found.withColumn("start", F.timestamp_micros("start"))


def outer_join(clicks: DataFrame, bought: DataFrame) -> DataFrame:
    """event_id, purchase_id: clicks with the purchases of their user within an hour after, or without any.

    A click without a purchase comes out when the watermark of both streams has
    passed its hour, and leaves the state then.
    """
    c = clicks.select("event_id", "user_id", "ts")
    p = bought.select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts"))
    return c.join(p, F.expr("user_id = p_user AND p_ts >= ts AND p_ts <= ts + INTERVAL 1 HOUR"), "left").select("event_id", "purchase_id")


def _events(spark: SparkSession, sf_dir: str, delay: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return stream(spark, replay(e, "ts"), e.schema, delay)


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= {CLOSED}")
def st_replay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose rows come in several batches."""
    return _plain(ran(windows(_events(spark, sf_dir, "1 hour"), "1 hour"), "replay-windows")[0])


@query("SELECT DISTINCT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day FROM events")
def st_replay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(ran(first_of_day(_events(spark, sf_dir, "1 day")), "replay-dedup")[0])


@query(f"""
WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, event_type, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}
""")
def st_session_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sessions kept in lists and closed by timers of event time."""
    with state_store(spark):
        return _plain(ran(sessions(_events(spark, sf_dir, "1 hour")), "session-timers")[0])


@query("""
WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 1 HOUR AS passed)
SELECT c.event_id, p.event_id AS purchase_id FROM c LEFT JOIN p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR, w
WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 1 HOUR < w.passed
""")
def st_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    folder = replay(e, "ts")
    side = lambda kind: stream(spark, folder, e.schema, "1 hour").filter(F.col("event_type") == kind)
    return ran(outer_join(side("click"), side("purchase")), "outer-join")[0]
