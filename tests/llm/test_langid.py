"""Language identification: n-grams and FTRL against plain versions, held-out accuracy, odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tarnwick.llm import langid
from tests.llm.test_documents import frame, odd_rows


def brute_grams(text):
    out = collections.Counter()
    row = re.sub(" +", " ", " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text) + " ")
    for n in range(1, langid.ORDER + 1):
        for i in range(len(row) - n + 1):
            g = row[i : i + n]
            if " " in g[1:-1] or g == " ":
                continue
            h = 0
            for k, c in enumerate(g):
                h = (h * 0x100000001B3 + ord(c) + k + 1) & (1 << 64) - 1
            h = ((h ^ h >> 29) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
            out[h >> 64 - langid.HASH_BITS] += 1
    return out


def test_grams_of_whole_texts_in_any_blocks(monkeypatch):
    rng, grams = random.Random(3), langid.Grams()
    texts = ["", " ", "a", "Ab", "ÄÖ ß İx", "日本 x", "12 3a4", "a  b   c", "word" * 50]
    texts += ["".join(rng.choice("ab é.1") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for block in (1 << 18, 1, 2, 3, 7):
        monkeypatch.setattr(langid, "BLOCK", block)
        for t in texts:
            found, count = grams(t)
            assert dict(zip(found.tolist(), count.tolist())) == (brute_grams(t) if t else {}), (block, t)


def brute_ftrl(rows, y, classes, alpha, beta, lasso, ridge, epochs, features):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i, c):
        v = z[i, c]
        return 0.0 if abs(v) <= lasso else -(v - math.copysign(lasso, v)) / ((beta + math.sqrt(n[i, c])) / alpha + ridge)

    for _ in range(epochs):
        for row, label in zip(rows, y):
            row = [*row, (features, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in row for c in range(classes)}
            s = [sum(v * w[i, c] for i, v in row) for c in range(classes)]
            e = [math.exp(x - max(s)) for x in s]
            for c in range(classes):
                d = e[c] / sum(e) - (c == label)
                for i, v in row:
                    g = d * v
                    step = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha
                    z[i, c] += g - step * w[i, c]
                    n[i, c] += g * g
    return np.array([[weight(i, c) for c in range(classes)] for i in range(features + 1)])


def test_ftrl_equals_a_plain_version_and_is_sparse():
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.random(6)) for _ in range(60)]
    y = np.array([int(f[0] % 3) for f, _ in rows])
    args = (0.5, 1.0, 1.0, 0.1, 3, 30)
    got = langid.ftrl(rows, y, 3, *args)
    want = brute_ftrl([list(zip(f.tolist(), v.tolist())) for f, v in rows], y.tolist(), 3, *args)
    assert np.allclose(got, want, atol=1e-12) and (got == 0).sum() == (want == 0).sum() > 10


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 3000)
    logits = rng.standard_normal((3000, 3)) + 2 * np.eye(3)[y]
    t = langid.temperature(5 * logits, y)
    loss = lambda t: -np.log(langid.softmax(5 * logits / t)[np.arange(3000), y]).mean()
    assert min((loss(x), x) for x in np.arange(1, 20, 0.05))[1] - 0.2 < t < min((loss(x), x) for x in np.arange(1, 20, 0.05))[1] + 0.2
    assert langid.temperature(logits[:0], y[:0]) == 1.0 and 0.1 < langid.temperature(10 * np.eye(3), np.arange(3))


def test_op11_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op11_langid(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]
    assert sum(right) >= 0.98 * len(held) and abs(np.mean(right) - np.mean([r["score"] for r in held])) < 0.03


def test_neither_held_out_languages_nor_partitions_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held_out, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None)).repartition(7)
    one, two = langid.fit(docs), langid.fit(other)
    assert one["languages"] == two["languages"] == ["de", "en", "es", "fr"] and one["temperature"] == two["temperature"]
    assert (one["weights"] == two["weights"]).all() and (one["idf"] == two["idf"]).all() and len(one["at"]) < 1 << langid.HASH_BITS


def test_odd_rows(spark):
    rows = odd_rows() + [(200 + i, "der die das und ist nicht " * 3, "de", "s", 0) for i in range(30)] + [(300 + i, "the and of this is not " * 3, "en", "s", 0) for i in range(30)] + [(400, "123 !?", "en", "s", 0)]
    docs = frame(spark, rows).repartition(3)
    got = langid.identify(docs).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    by = {r["doc_id"]: r for r in got}
    for i in (100, 101, 102, 400):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[210]["lang_pred"] == "de" and by[310]["lang_pred"] == "en" and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 103}) == 1
    assert langid.identify(docs.limit(0)).count() == 0
    # Nothing to learn from, and a single language.
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)} and len(none) == len(rows)
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit("x"))).collect()} == {"und", "x"}


def test_the_sample_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, sample=10, languages=2)
    assert model["languages"] == ["de", "en"] or len(model["languages"]) == 2
