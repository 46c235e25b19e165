"""Streams over several batches: progress, state that outlives its batch, timers, evictions, late rows."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from tarnwick.sources.tables import scratch
from tarnwick.streaming import replay

T0 = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def batches(progress):
    return [p for p in progress if p["numInputRows"] > 0]


def rows_in_state(progress):
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def test_files_follow_each_other_in_time(spark):
    folder = replay.replay(events(spark), "ts", 5, 100)  # more than five files, as 1,000 rows are to go into files of 100
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    status = [s for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.getPath().getName().startswith("part-")]
    status.sort(key=lambda s: s.getModificationTime())
    spans = [spark.read.parquet(s.getPath().toString()).agg(F.min("ts"), F.max("ts"), F.count("ts")).first() for s in status]
    assert len(spans) >= 10 and all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and sum(s[2] for s in spans) == 1000


def test_windows_and_keys_stay_in_state_across_batches(spark):
    e = events(spark)
    for make, delay in ((lambda s: replay.windows(s, "1 day"), "1 hour"), (replay.first_of_day, "1 day")):
        stream = replay.stream(spark, replay.replay(e, "ts", 7, 10_000), e.schema, delay)
        out, progress = replay.ran(make(stream), "test-state")
        assert len(batches(progress)) == 7 and out.count() > 0
        held = rows_in_state(progress)
        # State is there before the second batch, and shrinks when the watermark passes it.
        assert held[0] > 0 and any(b < a for a, b in zip(held, held[1:]))
        assert all(s["numRowsDroppedByWatermark"] == 0 for p in progress for s in p["stateOperators"])


def brute_sessions(rows, gap, closed):
    by, out = collections.defaultdict(list), collections.Counter()
    for _, t, u, kind in rows:
        by[u].append((t, kind))
    for u, found in by.items():
        runs = []
        for t, kind in sorted(found, key=lambda x: x[0]):
            if runs and t - runs[-1][-1][0] < gap:
                runs[-1].append((t, kind))
            else:
                runs.append([(t, kind)])
        out.update((u, r[0][0], len(r), len({k for _, k in r if k is not None})) for r in runs if r[-1][0] + gap <= closed)
    return out


def test_timers_close_sessions_of_rows_in_any_order_that_the_watermark_allows(spark):
    rng = random.Random(1)
    rows = [(i, T0 + dt.timedelta(minutes=i // 2, seconds=rng.randint(0, 59)), rng.randint(0, 3), rng.choice(["a", "b", None])) for i in range(600) if i % 200 < 120]
    files = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for f in files:
        rng.shuffle(f)
    for a, b in zip(files, files[1:]):  # rows that come a batch later than they should, within the watermark's delay
        b.insert(0, a.pop())
    late = (9000, T0, 1, "a")  # hours behind the watermark by then
    files[-1].append(late)
    folder = scratch(spark, "late-sessions")
    for i, f in enumerate(files):
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    with replay.state_store(spark):
        out, progress = replay.ran(replay.sessions(stream, 10 * 60 * 1_000_000), "test-sessions")
    got = collections.Counter(tuple(r) for r in out.withColumn("start", F.col("start").cast("timestamp_ntz")).collect())
    closed = max(t for _, t, _, _ in rows) - dt.timedelta(hours=2)
    want = brute_sessions(rows, dt.timedelta(minutes=10), closed)
    assert got == want and len(want) > 3 and len(batches(progress)) == len(files) >= 5
    dropped = sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    assert dropped == 1
    # A session of rows of several files: its state was written in one batch and read in another.
    number = {r[0]: k for k, f in enumerate(files) for r in f}
    spans = collections.defaultdict(set)
    for r in rows:
        for u, start, n, _ in want:
            if r[2] == u and start <= r[1] < start + dt.timedelta(minutes=50):  # a burst takes 60 minutes, the next follows 40 later
                spans[u, start].add(number[r[0]])
    assert any(len(s) > 1 for s in spans.values())


def test_open_sessions_are_kept_as_runs_in_few_parts_of_state(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i // 4), None if i % 4 == 3 else i % 4, "a" if i % 8 < 4 else "b") for i in range(2000)]  # four users that never pause
    rows += [(5000 + i, T0 + dt.timedelta(days=2, hours=i), 7, None) for i in range(4)]
    e = spark.createDataFrame([*rows, (9000, None, 1, "a")], SCHEMA)
    with replay.setting(spark, "spark.sql.shuffle.partitions", "64"), replay.state_store(spark):
        stream = replay.stream(spark, replay.replay(e, "ts", 6), e.schema, "1 hour")
        out, progress = replay.ran(replay.sessions(stream), "test-runs")
    got = collections.Counter(tuple(r) for r in out.withColumn("start", F.col("start").cast("timestamp_ntz")).collect())
    assert got == brute_sessions(rows, dt.timedelta(minutes=30), max(r[1] for r in rows) - dt.timedelta(hours=1)) and len(got) > 4
    assert max(rows_in_state(progress)) < 50  # timers included; rows in lists would be hundreds
    assert {s["numShufflePartitions"] for p in progress for s in p["stateOperators"]} == {2 * spark.sparkContext.defaultParallelism}


def test_unmatched_rows_of_an_outer_join_leave_the_state(spark):
    e = events(spark)
    folder = replay.replay(e, "ts", 6, 10_000)
    side = lambda kind: replay.stream(spark, folder, e.schema, "1 hour").filter(F.col("event_type") == kind)
    out, progress = replay.ran(replay.outer_join(side("click"), side("purchase")), "test-outer")
    clicks = e.filter("event_type = 'click'").count()
    found = out.collect()
    assert len(batches(progress)) >= 5 and 0 < sum(r["purchase_id"] is None for r in found) <= clicks
    assert sum(r["purchase_id"] is None for r in found) > 0.9 * clicks  # of the last hours only, the outcome is open
    held = rows_in_state(progress)
    assert max(held) < 0.6 * clicks and any(b < a for a, b in zip(held, held[1:]))


def test_an_empty_table(spark):
    e = events(spark).limit(0)
    out, progress = replay.ran(replay.windows(replay.stream(spark, replay.replay(e, "ts"), e.schema, "1 hour"), "1 hour"), "test-empty")
    assert out.count() == 0 and not batches(progress)
