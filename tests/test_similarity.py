"""The similarity join of names against all pairs, and its classes against a plain search."""

import collections
import random

from tarnwick.operators import similarity
from tarnwick.operators.queries import op_name_similarity


def brute(names):
    sets = {s: {s[i : i + 3] for i in range(max(len(s) - 2, 1))} for s in {n.lower() for n in names if n is not None}}
    return {(a, b): round(1 - len(x & y) / len(x | y), 6) for a, x in sets.items() for b, y in sets.items() if a < b and 5 * len(x & y) > 2 * len(x | y)}


def brute_classes(names, pairs):
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for s in sorted({n.lower() for n in names if n is not None}):
        if s not in out:
            left = [s]
            while left:
                at = left.pop()
                if at not in out:
                    out[at] = s
                    left.extend(near[at])
    return {s: (len(near[s]), c) for s, c in out.items()}


def test_links_and_classes_of_odd_names(spark):
    rng = random.Random(11)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(400)] + [None, "AB", "ab", "ab"]
    df = spark.createDataFrame([(n, 1, "x") for n in names], "p_name string, rows int, class string")
    want = brute(names)
    strings = df.selectExpr("lower(p_name) AS s").filter("s IS NOT NULL").distinct()
    assert len(want) > 300 and {(r["name"], r["other"]): r["distance"] for r in similarity.alike(strings).collect()} == want
    got = {r["name"]: (r["links"], r["class"]) for r in similarity.similar_classes(df, "p_name").collect()}
    assert got == brute_classes(names, want)
    assert {r["name"]: r["rows"] for r in similarity.similar_classes(df, "p_name").collect()} == collections.Counter(n.lower() for n in names if n is not None)
    assert similarity.similar_classes(df.limit(0), "p_name").count() == 0


def test_classes_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(500, i) for i in range(501, 560)]
    nodes = spark.createDataFrame([(i,) for i in [*range(100, 181), *range(500, 560), 7, 7]], "node long")
    got = {r["node"]: r["class"] for r in similarity.classes(nodes, spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(100, 181), 100) | dict.fromkeys(range(500, 560), 500) | {7: 7}


def test_part_names(spark):
    sf = "/root/testdata/sf0.1"
    names = [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").collect()]
    rows = op_name_similarity(spark, sf).collect()
    assert {r["name"]: (r["links"], r["class"]) for r in rows} == brute_classes(names, brute(names)) and sum(r["links"] for r in rows) == 88
