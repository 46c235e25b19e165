"""Product codes against a plain Lloyd's algorithm in integers."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pytest

from tarnwick.llm import codes
from tests.llm.test_vectors import INF, NAN, frame, odd_vectors


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, vector, label).  Plain rounds, every distance computed."""
    kept = [(i, [math.floor(scale * float(c)) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(-(-max(len(v) for _, v, _ in kept) // parts), 1)
    kept = [(i, v + [0] * (width * parts - len(v)), y) for i, v, y in kept]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    start = [first[i] for i in sorted(first)[:entries]] or [[0] * (width * parts)]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in start] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = collections.defaultdict(list)
            for _, v, _ in kept:
                held[nearest(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(book)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, by = [], collections.defaultdict(int)
    for i, v, y in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
        by[y] += out[-1][2]
    long = lambda e: e if e < 1 << 63 else None
    return collections.Counter((i, code, long(e), long(by[y]), sha) for i, code, e, y in out)


def results(df):
    return collections.Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def labelled(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], f"vec_id long, embedding array<{kind}>, label int, id string, error int")


def test_op12_query_and_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = codes.op12_codes(spark, sf)
    assert [t for _, t in got.dtypes] == ["bigint", "string", "bigint", "bigint", "string"]
    assert results(got) == brute(rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = c.execute(codes.OP12_SQL)
    assert [d[0] for d in found.description] == got.columns and collections.Counter(found.fetchall()) == brute(rows)


def test_odd_vectors(spark):
    rows = [(i, v, None if i is None or i % 7 == 0 else i % 3) for i, v in odd_vectors()]
    rows += [(i, [0.5] * 8, 1) for i in range(3000, 3040)] + [(3, [float(i), *[0.1] * 7], 2) for i in range(3)] + [(4000, [1.0] * 3, 2)]
    df = labelled(spark, rows).repartition(5)
    assert results(codes.compress(df)) == brute(rows)
    assert codes.compress(df.limit(0)).count() == 0 and codes.compress(df.filter("vec_id = 2020 AND label > 9")).count() == 0
    for few in (rows[:3], [(None, [1.0, 2.0], 1), (None, [5.0, -2.0], None)], [(1, [], 1), (2, [], 1)], [(1, None, 1), (2, [NAN], 1), (3, [INF], 2)]):
        got = results(codes.compress(labelled(spark, few)))
        assert got == (brute(few) if any(v is not None and all(map(math.isfinite, v)) for _, v, _ in few) else collections.Counter())


def test_ties_between_entries_go_to_the_lower_index(spark):
    """Small integer grids: equal distances at every turn."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-2, 3, 8) / 4096).tolist(), int(i % 4)) for i in range(400)]
    assert results(codes.compress(labelled(spark, rows, "double"))) == brute(rows)


@pytest.mark.parametrize("size", [1e6, 1e30])
def test_components_beyond_doubles_and_longs(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * (size if i % 5 == 0 else 1.0)).tolist(), i % 3) for i in range(80)]
    got = results(codes.compress(labelled(spark, rows, "double")))
    assert got == brute(rows) and (size < 1e7 or any(r[2] is None for r in got))


def test_bounds_save_scans_and_sums_are_whole(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[rng.integers(12)] + 0.05 * rng.standard_normal(16)).tolist(), 0) for i in range(600)]
    df = labelled(spark, rows).selectExpr("vec_id AS id", "label", "embedding AS vec").repartition(4)
    books = codes.Books(df, 8, 16, 6, 4096)
    assert books.scans[0] == 8 * 600 and books.scans[-1] < 0.5 * books.scans[0]
    assert codes.limbs(-5, 3) == [(1 << 40) - 5, (1 << 40) - 1, -1] and sum(v << 40 * k for k, v in enumerate(codes.limbs(-12345678901234567890123, 3))) == -12345678901234567890123
