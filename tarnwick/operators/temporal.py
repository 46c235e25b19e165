"""Operators on time: as-of join, interval join, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators.ordered import written

#: Most tasks of an interval join.
MAX_TASKS = 20_000


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, take: list[str], bucket: int = 30 * 86_400) -> DataFrame:
    """left with the columns `take` of the last right row of its key at or before its time (null if none).

    Both sides are dealt out by key and time bucket (of so many seconds), so a key with very many
    rows spreads over its buckets; the last right row of earlier buckets is
    carried over by a window of one row per bucket.  Right rows of equal key
    and time are ordered by `take`, the largest last.  Rows without a time
    match nothing.
    """
    start = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / bucket)
    value = F.struct(*take)
    l = left.select(F.col(by).alias("_by"), F.col(left_time).alias("_t"), F.struct("*").alias("_row"))
    r = right.filter(F.col(right_time).isNotNull()).select(F.col(by).alias("_by"), F.col(right_time).alias("_t"), value.alias("_v"))
    l, r = l.withColumn("_b", start(F.col("_t"))), r.withColumn("_b", start(F.col("_t")))
    last = r.groupBy("_by", "_b").agg(F.max(F.struct("_t", "_v")).alias("_m")).select("_by", "_b", F.col("_m._v").alias("_v"))
    spans = last.unionByName(l.select("_by", "_b").distinct(), allowMissingColumns=True).groupBy("_by", "_b").agg(F.max("_v").alias("_v"))
    before = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("_by", "_b", F.last("_v", ignorenulls=True).over(before).alias("_carry"))
    both = l.withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    within = Window.partitionBy("_by", "_b").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(within)).filter("_side = 1")
    out = seen.join(carried, (seen["_by"].eqNullSafe(carried["_by"])) & (seen["_b"].eqNullSafe(carried["_b"])), "left")
    found = F.when(F.col("_t").isNotNull() & seen["_by"].isNotNull(), F.coalesce("_seen", "_carry"))
    return out.select("_row.*", *[found[c].alias(c) for c in take])


def interval_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float, side: int = 2048) -> DataFrame:
    """Pairs of a point and the spans [low, high) that hold it, as an equi-join on buckets of `width`.

    A span is dealt to every bucket that it touches, so width should be about
    the spans' usual length.  Both sides of a bucket are cut into parts of about
    `side` rows by a hash of the row, and every part of one meets every part of
    the other in a cell of its own.  Tasks are as many as the pairs to compare
    ask for: pairs grow faster than bytes, by which Spark would choose.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    deal = lambda df: F.xxhash64(*df.columns)
    p = points.filter(F.col(point).isNotNull()).select("*", deal(points).alias("_hash")).withColumn("_bucket", bucket(F.col(point)))
    s = spans.filter(F.col(low) < F.col(high)).select("*", deal(spans).alias("_hash")).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    # One row a bucket that both sides have.
    count = lambda df, name: df.groupBy("_bucket").agg(F.count(F.lit(1)).alias(name))
    sizes = written(count(p, "_p").join(count(s, "_s"), "_bucket"), "interval-buckets")
    pairs = sizes.agg(F.sum(F.col("_p").cast("double") * F.col("_s"))).first()[0] or 0
    parts = lambda n: F.ceil(F.col(n) / side).cast("int")
    sizes = sizes.select("_bucket", parts("_p").alias("_p"), parts("_s").alias("_s"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("_hash", n).cast("int")
    tasks = min(MAX_TASKS, int(pairs // side**2) + 1)
    cells = ["_bucket", "_i", "_j"]
    p = p.join(sizes, "_bucket").withColumn("_i", own("_p")).withColumn("_j", every("_s")).drop("_p", "_s", "_hash").repartition(tasks, *cells)
    s = s.join(sizes, "_bucket").withColumn("_j", own("_s")).withColumn("_i", every("_p")).drop("_p", "_s", "_hash").repartition(tasks, *cells)
    return p.join(s, cells).filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(*cells)


def recent_count(events: DataFrame, by: str, time: str, hours: int = 1) -> DataFrame:
    """events with n: how many events of its key lie within so many hours before it, itself and those of its own time included.

    Every event is dealt to its own span of `hours` and to the next, so that a
    key with very many rows is sorted span by span.  Events without a time are
    left out.
    """
    span = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / (3600 * hours))
    dealt = events.withColumn("_own", span).filter("_own IS NOT NULL").withColumn("_span", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy(by, "_span").orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-hours * 3_600_000_000, 0)
    return dealt.withColumn("n", F.count(F.lit(1)).over(w)).filter("_span = _own").drop("_own", "_span")


def sessions(events: DataFrame, by: str, time: str, gap: str) -> DataFrame:
    """by, start, end (start of the gap after the last event), n: runs of events less than `gap` apart."""
    s = F.session_window(F.col(time), gap)
    return events.groupBy(by, s.alias("s")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def tumbling(time: Column, width: str) -> Column:
    """Start of the window, as a timestamp without zone."""
    return F.window(time, width).start.cast("timestamp_ntz")
