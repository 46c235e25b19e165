"""Operators on edge cases: ties, nulls, hot keys, late rows."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import ordered, pruning, sketches, skew, temporal
from tarnwick.sources.tables import scratch
from tarnwick.streaming.queries import drained

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def test_asof_join_takes_the_last_row_of_any_earlier_bucket(spark):
    rng = random.Random(4)
    left = [(i, "hot" if i % 3 else f"k{i % 5}", at(rng.randint(0, 2000))) for i in range(300)] + [(900, None, at(5)), (901, "hot", None), (902, "absent", at(3)), (903, "hot", at(-1))]
    right = [("hot" if i % 2 else f"k{i % 5}", at(rng.randint(0, 1500)), i) for i in range(80)] + [("hot", at(10), 500), ("hot", at(10), 400), (None, at(1), 1), ("hot", None, 2)]
    l = spark.createDataFrame(left, "id long, k string, t timestamp").withColumn("_v", F.lit(1))
    r = spark.createDataFrame(right, "k string, u timestamp, v long")
    for bucket in (86_400, 400 * 86_400):
        got = {x["id"]: x["v"] for x in temporal.asof_join(l, r, "k", "t", "u", ["v"], bucket).collect()}
        for i, k, t in left:
            fit = [(u, v) for rk, u, v in right if k is not None and rk == k and t is not None and u is not None and u <= t]
            assert got[i] == (max(fit)[1] if fit else None)
    assert temporal.asof_join(l.limit(0), r, "k", "t", "u", ["v"]).count() == 0
    assert temporal.asof_join(l, r.limit(0), "k", "t", "u", ["v"]).filter("v IS NOT NULL").count() == 0


def test_interval_join_meets_each_pair_once(spark):
    rng = random.Random(5)
    p = [(i, rng.uniform(-50, 50)) for i in range(200)] + [(900, None), (901, 10.0)]
    s = [(i, a, a + rng.choice([0.0, 1.0, 30.0])) for i, a in enumerate(rng.uniform(-60, 60) for _ in range(60))] + [(800, 10.0, 20.0), (801, 0.0, 10.0), (802, None, 5.0), (803, 9.0, 3.0)]
    got = temporal.interval_join(spark.createDataFrame(p, "p long, x double"), spark.createDataFrame(s, "s long, a double, b double"), "x", "a", "b", 7.0)
    want = sorted((i, j) for i, x in p for j, a, b in s if x is not None and a is not None and a <= x < b)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want


def test_interval_join_cuts_a_bucket_of_many_pairs(spark):
    p, s = [(i, float(i % 3)) for i in range(900)], [(i, float(i % 2), 3.0) for i in range(300)]
    points, spans = spark.createDataFrame(p, "p long, x double"), spark.createDataFrame(s, "s long, a double, b double")
    got = temporal.interval_join(points, spans, "x", "a", "b", 100.0, side=64)
    want = sorted((i, j) for i, x in p for j, a, b in s if a <= x < b)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want
    held = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(held) > 16 and max(held) < len(want) / 6  # all pairs are of one bucket


def test_salted_join_equals_a_plain_one(spark):
    rng = random.Random(6)
    left = [(i, "hot" if i % 3 else rng.choice(["a", "b", None, "gone"])) for i in range(2000)]
    right = [("hot", 1), ("hot", 2), ("a", 3), (None, 4), ("unused", 5)]
    l, r = spark.createDataFrame(left, "id long, k string"), spark.createDataFrame(right, "k string, v long")
    for how in ("inner", "left"):
        want = collections.Counter(map(tuple, l.join(r, "k", how).select("id", "k", "v").collect()))
        got = skew.salted_join(l, r, ["k"], how, salts=4, least=100)
        assert collections.Counter(map(tuple, got.select("id", "k", "v").collect())) == want
    assert skew.salted_join(l.limit(0), r, ["k"]).count() == skew.salted_join(l, r.limit(0), ["k"]).count() == 0


def test_block_search_equals_a_full_scan(spark):
    rng = random.Random(7)
    v = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(v, "id long, v array<double>")
    got = skew.block_search(df, df.filter("id % 50 = 0"), 5, block=16).collect()
    want = set()
    for q, w in v[::50]:
        scored = sorted((-sum(a * b for a, b in zip(w, x, strict=True)), i) for i, x in v if i != q)
        want |= {(q, i, -s) for s, i in scored[:5]}
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)


def test_block_search_scores_copies_alike_and_keeps_odd_vectors_in_order(spark):
    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(40)]
    v = [(i, base[i % 40]) for i in range(1200)] + [(1201, None), (1202, [None] * 64), (1203, [1.0]), (1204, [float("nan")] * 64), (1205, [float("inf")] * 64), (1206, [-float("inf")] * 64), (1250, None), (1300, [1.0]), (None, base[0])]
    df = spark.createDataFrame(v, "id long, v array<double>").repartition(5)

    def score(w, x):
        if w is None or x is None or len(w) != len(x) or None in x or None in w:
            return None
        s = 0.0
        for a, b in zip(w, x):
            s += a * b
        return s

    place = lambda s: 2 if s is None else (0 if s != s else 1)
    want = []
    for q, w in v:
        if q is not None and q % 50 == 0:
            scored = [(place(s), -s if place(s) == 1 else 0, i, s) for i, x in v if i is not None and i != q for s in [score(w, x)]]
            want += [(q, i, repr(s)) for _, _, i, s in sorted(scored, key=lambda t: t[:3])[:35]]
    for block in (16, 64, 8192):
        got = skew.block_search(df, df.filter("id % 50 = 0"), 35, block=block).collect()
        assert sorted((r["query_id"], r["vec_id"], repr(r["score"])) for r in got) == sorted(want)


def test_block_search_takes_no_row_of_python_or_lambda_a_pair(spark):
    df = spark.range(400).selectExpr("id", "array(cast(id as double)) AS v")
    plan = skew.block_search(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "lambda" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_bucketed_join_shuffles_neither_side(spark):
    from tarnwick import catalog

    plan = catalog.QUERIES["s_bucketed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    assert "Exchange" not in join and "Bucketed: true" in join


def test_sketches_are_near_the_truth(spark):
    from tarnwick import catalog

    exact = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_partkey").distinct().count()
    found = catalog.QUERIES["op_distinct_sketch"](spark, "/root/testdata/sf0.01").first()["parts"]
    assert abs(found - exact) < 0.05 * exact


def test_approximate_percentiles_and_counts_are_near_the_truth(spark):
    from tarnwick import catalog

    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_returnflag", "l_extendedprice", "l_partkey").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for r in catalog.QUERIES["op_approx_percentile"](spark, "/root/testdata/sf0.01").collect():
        prices = sorted(x[1] for x in by[r["l_returnflag"]])
        below, at = sum(p < r["med"] for p in prices), sum(p <= r["med"] for p in prices)
        assert below - len(prices) / 1000 <= len(prices) / 2 <= at + len(prices) / 1000
        exact = len({x[2] for x in by[r["l_returnflag"]]})
        assert abs(r["parts"] - exact) < 0.15 * exact


def test_medians_and_recent_counts_of_odd_rows(spark):
    rng = random.Random(8)
    rows = [(f"k{i % 3}", None if i % 17 == 0 else float(rng.randint(-5, 5) * rng.choice([1, 1000]))) for i in range(200)] + [("one", 7.0), ("none", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    groups = collections.defaultdict(list)
    for k, x in rows:
        if x is not None and k is not None:
            groups[k].append(x)
    got = {r["k"]: r["percentile"] for r in ordered.percentiles(df, ["k"], "x", [0.5]).collect() if r["k"] is not None}
    assert got == {k: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2 for k, v in groups.items()}
    events = [(i, "hot" if i % 4 else "b", at(rng.randint(0, 40) / 4)) for i in range(150)] + [(900, "hot", None)]
    found = {r["id"]: r["n"] for r in temporal.recent_count(spark.createDataFrame(events, "id long, k string, t timestamp"), "k", "t").collect()}
    assert found == {i: sum(k2 == k and t2 is not None and t - dt.timedelta(hours=1) <= t2 <= t for _, k2, t2 in events) for i, k, t in events if t is not None}


def test_broadcast_only_of_few_rows(spark):
    small = spark.range(10)
    assert "broadcast" in skew.broadcast_small(small)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in skew.broadcast_small(small, 5)._jdf.queryExecution().logical().toString().lower()


def test_late_rows_are_dropped_behind_the_watermark(spark):
    folder = scratch(spark, "late")
    schema = "event_id long, ts timestamp"
    for i, rows in enumerate(([(1, at(0)), (2, at(10))], [(3, at(20)), (4, at(9))], [(5, at(1)), (6, at(30))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    counts = stream.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    out = drained(counts.select(F.col("w.start").alias("start"), "n"), "late")
    got = {r["start"]: r["n"] for r in out.collect()}
    # Rows 4 (behind 10 - 2 hours: not late) and 5 (behind 20 - 2 hours: late).
    assert got[at(9)] == 1 and at(1) not in got and got[at(0)] == 1 and at(30) not in got


def test_plans_push_down_and_limit_early(spark):
    from tarnwick import catalog

    def plan(name):
        return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan("q_filter_range")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan("q_top_per_group")
    assert "WindowGroupLimit" in plan("q_top_per_group")
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan("s_partitioned")


def test_bitmaps_of_levels_count_exactly(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, 3, 4, None, 77]), rng.choice([None, 5, 40_000, 32_768, rng.randint(1, 300_000)])) for _ in range(500)]
    place = {1: (10, 100), 2: (10, 100), 3: (11, 100), 4: (None, None)}
    df = spark.createDataFrame(rows, "k long, v long")
    where = spark.createDataFrame([(k, *p) for k, p in place.items()], "k long, nation long, region long")
    want = collections.defaultdict(set)
    for k, v in rows:
        if k is not None and v is not None:
            want["k", k].add(v)
            if k in place:
                for level, key in zip(("nation", "region", "all"), (*place[k], None)):
                    want[level, key].add(v)
    got = {(r["level"], r["key"]): r["n"] for r in sketches.distinct_by_level(df, where, "k", "v", ["nation", "region"]).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    assert [tuple(r) for r in sketches.distinct_by_level(df.limit(0), where, "k", "v", ["nation", "region"]).collect()] == [("all", None, 0)]


def test_stored_quantile_sketches_keep_their_rank_error(spark):
    rng = random.Random(10)
    rows = [(i % 3, i % 10, None if i % 50 == 0 else rng.choice([5.0, rng.gauss(0, 1), float("nan")])) for i in range(60_000)]
    df = spark.createDataFrame(rows, "k long, day long, x double")
    folder = sketches.store_quantiles(df, ["k", "day"], "x")
    assert spark.read.parquet(folder).count() == 30
    for r in sketches.merged_quantiles(spark, folder, ["k"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
        v = sorted(x for k, _, x in rows if k == r["k"] and x is not None and x == x)
        low, high = sum(x < r["quantile"] for x in v), sum(x <= r["quantile"] for x in v)
        assert r["n"] == len(v) and low - 0.01 * len(v) <= r["share"] * len(v) <= high + 0.01 * len(v)
    assert sketches.merged_quantiles(spark, sketches.store_quantiles(df.limit(0), ["k", "day"], "x"), ["k"], [0.5]).count() == 0


def test_quantiles_of_suppliers_are_near_the_truth(spark):
    from tarnwick import catalog

    by = collections.defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_suppkey", "l_extendedprice").collect():
        by[r[0]].append(r[1])
    for r in catalog.QUERIES["op_quantile_sketches"](spark, "/root/testdata/sf0.01").collect():
        v = by[r["l_suppkey"]]
        assert abs(sum(x <= r["quantile"] for x in v) / len(v) - r["share"]) < 0.02 and r["n"] == len(v)


def test_theta_sets_are_exact_when_small_and_near_when_large(spark):
    rng = random.Random(12)
    rows = [("small", rng.randint(0, 300), rng.choice([True, False, None])) for _ in range(500)] + [("one", 1, True), ("none", None, True), (None, 4, False)]
    rows += [("large", i % 40_000, i % 40_000 < 30_000 if i < 40_000 else i % 40_000 < 10_000) for i in range(80_000)]
    df = spark.createDataFrame(rows, "k string, v long, f boolean")
    for r in sketches.set_counts(df, ["k"], "v", "f").collect():
        yes, no = ({v for k, v, f in rows if k == r["k"] and v is not None and f is on} for on in (True, False))
        want = [len(yes), len(no), len(yes & no), len(yes - no), len(no - yes), len(yes | no)]
        got = [r[c] for c in ("yes", "no", "both", "only_yes", "only_no", "either")]
        assert got == want if r["k"] != "large" else all(abs(a - b) < 0.06 * len(yes | no) for a, b in zip(got, want))
    assert sketches.set_counts(df.limit(0), ["k"], "v", "f").count() == 0


def scans(df):
    """(files read, executed plan) of a query, run without adaptive planning so that its scans can be asked."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = [leaves.apply(i).metrics().get("numFiles") for i in range(leaves.size())]
    return sum(m.get().value() for m in read if m.isDefined()), plan.toString()


def test_partitions_are_pruned_at_run_time(spark):
    rows = [(i, i % 40 if i % 41 else None) for i in range(2000)]
    fact = pruning.partitioned(spark.createDataFrame(rows, "id long, k int"), "k")
    dim = spark.createDataFrame([(k, k % 10) for k in range(40)], "key int, part int")
    dim.write.parquet(folder := scratch(spark, "dim"))
    dim = spark.read.parquet(folder)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.optimizer.dynamicPartitionPruning.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        read, plans = {}, {}
        for on in ("true", "false"):
            spark.conf.set("spark.sql.optimizer.dynamicPartitionPruning.enabled", on)
            df = fact.join(dim.filter("part = 3"), F.col("k") == F.col("key")).select("id", "k")
            read[on], plans[on] = scans(df)
            assert sorted(map(tuple, df.collect())) == sorted((i, k) for i, k in rows if k is not None and k % 10 == 3)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert "dynamicpruning" in plans["true"] and "dynamicpruning" not in plans["false"]
    assert read["true"] + 30 < read["false"]  # 4 folders of 41
    assert fact.filter("k IS NULL").count() == sum(k is None for _, k in rows)


def test_a_bloom_filter_meets_the_large_side_before_its_shuffle(spark):
    large, small = scratch(spark, "large"), scratch(spark, "small")
    spark.range(50_000).selectExpr("id % 9000 AS k", "id").write.parquet(large)
    spark.range(9000).selectExpr("id AS key", "CAST(id % 100 AS INT) AS part").write.parquet(small)
    l, s = spark.read.parquet(large), spark.read.parquet(small).filter("part = 7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pruning.runtime_filters(spark, "0"):
            df = l.join(s, F.col("k") == F.col("key"))
            assert "might_contain" in df._jdf.queryExecution().executedPlan().toString()
        assert "might_contain" not in l.join(s, F.col("k") == F.col("key"))._jdf.queryExecution().executedPlan().toString()
        got = pruning.filtered_join(l, s, F.col("k") == F.col("key"), "0")
        assert sorted(r["id"] for r in got.collect()) == [i for i in range(50_000) if i % 9000 % 100 == 7]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert pruning.filtered_join(l.limit(0), s, F.col("k") == F.col("key")).count() == 0


def test_table_function_of_a_partitioned_table(spark):
    from tarnwick.functions.queries import Since

    rng = random.Random(13)
    rows = [(f"e{i}", "hot" if i % 3 else rng.choice(["a", None]), rng.choice(["view", "buy", "other", None]), rng.randint(0, 50)) for i in range(300)]
    want, n = {}, collections.Counter()
    for e, u, kind, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if kind == "buy":
            want[e], n[u] = n[u], 0
        elif kind == "view":
            n[u] += 1
    df = spark.createDataFrame(rows, "id string, u string, kind string, t int")
    spark.udtf.register("since_test", F.udtf(Since))
    ask = lambda d: spark.sql("SELECT * FROM since_test(TABLE({d}) PARTITION BY u ORDER BY (t, id), 'id', 'kind', 'view', 'buy')", d=d)
    got = ask(df)
    assert got.dtypes == [("id", "string"), ("n_view", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(want.items()) and ask(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="constant strings"):
        spark.sql("SELECT * FROM since_test(TABLE({d}), 1, 'kind', 'view', 'buy')", d=df)
