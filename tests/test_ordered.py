"""Operators on order against plain Python, and the rows that their largest tasks read."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators import ordered


def most_read(spark, run):
    """The largest number of rows that a task of the jobs of run() read from a shuffle of 64 partitions, small ones not merged."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("64", "false", "-1")):
            spark.conf.set(k, v)
        run()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = stages()
    most = 0
    for i in range(found.size()):
        s = found.apply(i)
        if s.stageId() not in before and s.shuffleReadRecords():
            tasks = store.taskList(s.stageId(), s.attemptId(), 100_000)
            for k in range(tasks.size()):
                m = tasks.apply(k).taskMetrics()
                most = max(most, m.get().shuffleReadMetrics().recordsRead() if m.isDefined() else 0)
    return most


def brute_percentile(values, share):
    v = sorted(values)
    at = share * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


def test_percentiles_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(f"k{i % 3}", None if i % 17 == 0 else float(rng.randint(-5, 5) * rng.choice([1, 1000])), i) for i in range(300)]
    rows += [("one", 7.0, 0), ("none", None, 0), (None, 1.0, 0), (None, 4.0, 0)] * 2
    df = spark.createDataFrame(rows, "k string, x double, share long")
    by = collections.defaultdict(list)
    for k, x, _ in rows:
        if x is not None:
            by[k].append(x)
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r["k"], r["share"]): r["percentile"] for r in ordered.percentiles(df.select("k", "x"), ["k"], "x", shares, 16).collect()}
    assert got == {(k, s): pytest.approx(brute_percentile(v, s), abs=1e-9) for k, v in by.items() for s in shares}
    assert ordered.percentiles(df.limit(0).select("k", "x"), ["k"], "x", shares).count() == 0


def test_a_heap_of_equal_values_stays_within_the_bound(spark):
    """One group, 95 % of its rows with one value: no task reads more than twice the rows of a range, or the map tasks' partial counts."""
    df = spark.range(200_000, numPartitions=8).select(F.lit(1).alias("k"), F.when(F.col("id") % 20 > 0, 5.0).otherwise(F.col("id") / 7).alias("x"))
    found = []
    most = most_read(spark, lambda: found.extend(ordered.percentiles(df, ["k"], "x", [0.25, 0.5, 0.999], 1000).collect()))
    values = [5.0 if i % 20 else i / 7 for i in range(200_000)]
    assert {r["share"]: r["percentile"] for r in found} == {s: pytest.approx(brute_percentile(values, s)) for s in (0.25, 0.5, 0.999)}
    assert most <= 2500


def windows(df, by, order):
    w = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order.items()])
    return df.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w)})


def test_ranks_equal_window_functions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 0.5, 1.5, 2.5]), rng.choice(["x", "y", None]), i % 50) for i in range(400)] + [("single", 1.0, "x", 1)]
    df = spark.createDataFrame(rows, "k string, v double, t string, id long")
    for order in ({"v": True}, {"v": False, "t": True}):
        cols = [*df.columns, "rank", "dense_rank", "percent_rank", "cume_dist"]
        got = collections.Counter(repr(tuple(r)) for r in ordered.ranks(df, ["k"], order, 32).select(cols).collect())
        assert got == collections.Counter(repr(tuple(r)) for r in windows(df, ["k"], order).select(cols).collect())
    out = ordered.ranks(df, ["k"], {"v": True, "t": True, "id": True}, 16).withColumn("tile", ordered.ntile(7)).collect()
    sizes = collections.Counter((r["k"], r["tile"]) for r in out)
    for k in ("a", "b", None, "single"):
        mine = [r for r in out if r["k"] == k]
        assert sorted(r["row_number"] for r in mine) == list(range(1, len(mine) + 1))
        assert all(r["rank"] <= r["row_number"] < r["rank"] + r["peers"] for r in mine)
        q, more = divmod(len(mine), 7)
        assert [sizes[k, t] for t in range(1, 8)] == [q + (t <= more) for t in range(1, 8)]
    assert ordered.ranks(df.limit(0), ["k"], {"v": True}).count() == 0


def test_ranks_of_few_large_groups_stay_within_the_bound(spark):
    """25 nations at a hundred times their customers on sf0.001's scale, one of them with a third of the rows and a value with half of its rows."""
    nation = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 25)
    df = spark.range(60_000, numPartitions=8).select(nation.alias("k"), F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") * 7919 % 10_007).alias("v"), "id")
    found = []
    most = most_read(spark, lambda: found.append(ordered.ranks(df, ["k"], {"v": True}, 500).agg(F.sum("rank"), F.sum("dense_rank"), F.max("cume_dist")).first()))
    assert tuple(found[0]) == tuple(windows(df, ["k"], {"v": True}).agg(F.sum("rank"), F.sum("dense_rank"), F.max("cume_dist")).first())
    assert most <= 5000  # half of the rows hold one value, a third one key, and a key and value together a sixth: 10,000


def test_dominance_equals_all_pairs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 40, 130):
        x, asks, w = rng.integers(0, 9, n), rng.random(n) < 0.5, rng.integers(-3, 9, n)
        got = ordered.dominance(x, asks, w)
        want = [[j for j in range(i + 1, n) if x[j] > x[i] and not asks[j]] if asks[i] else [] for i in range(n)]
        assert got[0].tolist() == [len(j) for j in want] and got[1].tolist() == [int(w[j].sum()) if j else 0 for j in want]


@pytest.mark.parametrize("ops", [("<", ">"), ("<=", "<"), (">", ">="), (">=", "<=")])
def test_inequality_sums_equal_a_plain_join(spark, ops):
    rng = random.Random(4)
    pick = lambda: None if rng.random() < 0.03 else float(rng.randint(0, 12))
    left = [(i % 70, pick(), pick()) for i in range(150)]
    right = [(pick(), pick(), None if i % 11 == 0 else i) for i in range(170)]
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    l, r = spark.createDataFrame(left, "id long, x double, y double"), spark.createDataFrame(right, "u double, v double, weight long")
    want = collections.Counter()
    for i, x, y in left:
        hits = [w or 0 for u, v, w in right if None not in (x, y, u, v) and test[ops[0]](x, u) and test[ops[1]](y, v)]
        want[i, x, y, len(hits), sum(hits)] += 1
    for rows in (8, 1 << 18):
        got = ordered.inequality_sums(l, r, [("x", ops[0], "u"), ("y", ops[1], "v")], "weight", rows)
        assert collections.Counter(map(tuple, got.collect())) == want
    assert ordered.inequality_sums(l.limit(0), r, [("x", "<", "u"), ("y", "<", "v")], "weight").count() == 0
    assert ordered.inequality_sums(l, r.limit(0), [("x", "<", "u"), ("y", "<", "v")], "weight").filter("n > 0").count() == 0


def test_inequality_sums_never_make_pairs(spark):
    """All values of one column equal, and both columns alike: 4,000 x 4,000 rows, of which a task reads a few strips at most."""
    l = spark.range(4000).select("id", F.lit(1).alias("x"), "id", F.col("id").alias("y")).toDF("i", "x", "j", "y").drop("j")
    found = []
    most = most_read(spark, lambda: found.append(ordered.inequality_sums(l, l.withColumn("w", F.lit(2)), [("x", "<=", "x"), ("y", "<", "y")], "w", 200).agg(F.sum("n"), F.sum("total")).first()))
    assert tuple(found[0]) == (4000 * 3999 // 2, 4000 * 3999) and most <= 2100
