"""Searches by inner product against brute force, and odd vectors."""

import math

import numpy as np
import pytest

from tarnwick.llm import ann, topk

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, id string, score double, vec int")


def odd_vectors(n=300):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist()) for i in range(60)]  # copies, query ids among them
    rows += [(2000, None), (2020, [0.0] * 8), (2021, [NAN] * 8), (2022, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]), (2040, [INF] * 8), (None, [1.0] * 8), (2041, []), (5, x[5].tolist())]
    return rows


def brute(rows, k, scale=None, zero=False):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))}
    ok = {i: np.pad(v, (0, 8 - len(v))) for i, v in ok.items()}
    if scale:
        ok = {i: np.floor(scale * v) for i, v in ok.items()}
    out = {}
    for q in ok:
        if q % 20 == 0:
            out[q] = sorted(((float(ok[q] @ ok[c]), c) for c in ok if c != q), key=lambda s: (-s[0], s[1]))[:k]
    return out


def grouped(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_search_of_odd_vectors(spark):
    rows = odd_vectors()
    v = topk.quantised(frame(spark, rows))
    got = grouped(topk.search(v, v.filter("id % 20 = 0")))
    assert got == {q: [(int(s), c) for s, c in top] for q, top in brute(rows, 20, 64, zero=True).items()}
    few = topk.quantised(frame(spark, rows[:5]))
    assert grouped(topk.search(few, few.filter("id = 0"))) == {0: [(int(s), c) for s, c in brute(rows[:5], 20, 64)[0]]}
    assert topk.search(v.limit(0), v).count() == 0 and topk.search(v, v.limit(0)).count() == 0


def test_maxscore_equals_a_full_scan():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = np.asfortranarray(rng.integers(-9, 10, (300, 12)).astype(float))
        q = rng.integers(-9, 10, 12).astype(float)
        ids = rng.permutation(300)
        scores = x @ q
        floor = int(np.sort(scores)[-rng.integers(5, 60)])
        at, got, probed = topk.maxscore(q, topk.Shard(x, ids), 5, floor)
        want = np.lexsort((ids, -scores))[:5]
        assert (at == want).all() and (got == scores[want]).all() and 5 <= probed <= 300


def test_sparse_postings_and_probed_rows():
    rng = np.random.default_rng(4)
    x = rng.integers(1, 30, (4000, 40)) * (rng.random((4000, 40)) < 0.1)
    ids, share = np.arange(4000), []
    for _ in range(50):
        q = rng.integers(0, 20, 40) ** 2
        scores = x @ q
        at, got, probed = topk.maxscore(q, topk.Shard(x, ids), 20, int(np.sort(scores)[-200]))
        want = np.lexsort((ids, -scores))[:20]
        assert (at == want).all() and (got == scores[want]).all()
        share.append(probed / 4000)
    assert np.mean(share) < 0.5


def test_scores_beyond_doubles(spark):
    """Neighbouring scores near 2^56, and components that no long holds."""
    big = 1 << 28
    rows = [(i, [big + i, big - 1, 3 + i % 2]) for i in range(120)] + [(1000, [big, big, 1])]
    df = spark.createDataFrame(rows, "id long, vec array<long>")
    got = grouped(topk.search(df, df.filter("id % 20 = 0")))
    for q in (r for r in rows if r[0] % 20 == 0):
        want = sorted(((sum(a * b for a, b in zip(q[1], v)), i) for i, v in rows if i != q[0]), key=lambda s: (-s[0], s[1]))[:20]
        assert got[q[0]] == want and want[0][0] > 2**55
    with pytest.raises(Exception, match="64 bits"):
        topk.search(spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 1])], "id long, vec array<long>"), df)
    with pytest.raises(Exception, match="64 bits"):
        topk.quantised(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_approximate_search_of_odd_vectors(spark):
    rows = odd_vectors()
    df = frame(spark, rows)
    got, want = grouped(ann.search(df, df.filter("vec_id % 20 = 0"))), brute(rows, 20)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, top in want.items():
        assert len(got[q]) == len(top) and len({c for _, c in got[q]}) == len(top) and q not in {c for _, c in got[q]}
        assert got[q] == sorted(got[q], key=lambda s: (-s[0], s[1]))
        known = dict((c, s) for s, c in brute(rows, 10_000)[q])
        assert all(math.isclose(s, known[c], abs_tol=1e-12) for s, c in got[q])
        hits += sum(s >= top[-1][0] - 1e-12 for s, _ in got[q])
        total += len(top)
    assert hits / total > 0.95
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0
    few = frame(spark, rows[:5])
    assert [c for _, c in grouped(ann.search(few, few.filter("vec_id = 0")))[0]] == [c for _, c in brute(rows[:5], 20)[0]]


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got, hits, total = grouped(ann.search(df, df.filter("vec_id % 20 = 0"))), 0, 0
    for q, found in got.items():
        scores = x @ x[np.flatnonzero(ids == q)[0]]
        scores[ids == q] = -np.inf
        floor = np.sort(scores)[-20]
        hits, total = hits + sum(s >= floor - 1e-12 for s, _ in found), total + 20
    assert hits / total >= 0.95


def test_op3_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got, hits, total = grouped(ann.op3_ann(spark, "/root/testdata/sf0.001")), 0, 0
    assert got.keys() == {int(i) for i in ids if i % 20 == 0}
    for q, found in got.items():
        scores = x @ x[np.flatnonzero(ids == q)[0]]
        scores[ids == q] = -np.inf
        floor = np.sort(scores)[-20]
        hits, total = hits + sum(s >= floor - 1e-12 for s, _ in found), total + 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("clusters", [4, 400])
def test_the_scan_drops_few_true_neighbours(clusters):
    rng = np.random.default_rng(clusters)
    centre = rng.standard_normal((clusters, 65))
    x = (centre[rng.integers(0, clusters, 4000)] + 0.5 * rng.standard_normal((4000, 65))) @ ann.rotation(65)
    q = x[:50] + 0.1
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    qi, vi = ann.scan(q, x, np.full(50, np.inf), 20)
    found = set(zip(qi.tolist(), vi.tolist()))
    true = [(i, int(j)) for i in range(50) for j in np.argsort(d[i])[:20]]
    assert sum(p in found for p in true) / len(true) > 0.97
    assert len(found) < 0.7 * 50 * 4000
