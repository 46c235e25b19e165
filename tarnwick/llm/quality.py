"""Quality by compression: zstandard dictionaries built from good and bad text.

A text is compressed, block by block, once with each dictionary; whichever
compresses it better is the likelier class.  The difference of the compressed
sizes, normalised by the text's length, is the only feature: a logistic curve
calibrates it into a score.  Text that repeats itself compresses well with any
dictionary, so its difference is near 0, while good text gains clearly from the
good dictionary; over the sum of both sizes, small as it is there, chance would
decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: Labelled documents of each class that a model is fitted on at most, and the blocks that a dictionary is built from: about as many of each, spread over its whole text.
SAMPLE, BLOCKS = 1500, 12_000
DICTIONARY_BYTES, LEVEL = 256 * 1024, 2
#: Bytes compressed at a time: beyond them a text's own past helps more than a dictionary does.
BLOCK = 256


def blocks_of(data: bytes, most: int) -> list[bytes]:
    """At most `most` of a text's blocks, evenly spread from its start to its end."""
    n = -(-len(data) // BLOCK)
    return [data[i * BLOCK : (i + 1) * BLOCK] for i in (range(n) if n <= most else (k * n // most for k in range(most)))]


def build_dictionary(blocks: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the blocks; where they are too few to train one, their own bytes."""
    try:
        return zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


class Measure:
    """The normalised difference of a text's compressed sizes: positive where the good dictionary does better, 0 for an empty text."""

    def __init__(self, good: bytes, bad: bytes):
        def make(data):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)

        self.good, self.bad = make(good), make(bad)

    def __call__(self, data: bytes) -> float:
        good = bad = 0
        for i in range(0, len(data), BLOCK):
            block = data[i : i + BLOCK]
            good += len(self.good.compress(block))
            bad += len(self.bad.compress(block))
        return (bad - good) / len(data) if data else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(w0, w1) of P(y = 1) = 1 / (1 + exp(-(w0 + w1 x))), by Newton's method on the standardised x."""
    mean, spread = float(x.mean()), float(x.std()) or 1.0
    a, w = np.column_stack([np.ones(len(x)), (x - mean) / spread]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * mean / spread), float(w[1] / spread)


def _each(measure, kind: pa.DataType):
    """measure(data, y) of every text of the rows (h, id, y, data), which it replaces."""

    def run(batches):
        for b in batches:
            found = [measure(t.as_py() or b"", y) for t, y in zip(b.column(3), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, kind)], ["h", "id", "y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict:
    """A model from labelled documents whose crc32(doc_id as text) mod 3 is not 1.

    A document with both labels counts as bad.  Of each class the `sample` ids
    of the smallest hash are taken, and of the rows of one id that of the
    smallest text hash (then text), so neither repeated rows nor partitions
    change the model.  About half build the dictionaries, from BLOCKS blocks
    each (one a document at least); the others are measured whole, in tasks,
    and calibrate, weighed to the classes' shares among all training labels.
    The driver gets these blocks and measures of at most 2 * sample rows, never
    texts.  Null texts count as empty: they add no block and measure 0.  With one
    class or none, or no text to build from, the model is that share alone.
    """
    train = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1) AND crc32(cast(cast(doc_id AS string) AS binary)) % 3 != 1")
    train = train.groupBy("doc_id").agg(F.min("y").alias("y"))
    shares = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = shares.get(0, 0), shares.get(1, 0)
    flat = {"good": b"", "bad": b"", "weights": (math.log((n[1] + 1) / (n[0] + 1)) if sum(n) else 0.0, 0.0)}
    if not all(n):
        return flat
    order = F.xxhash64(F.col("doc_id"), F.lit(10))
    picked = train.filter("y = 0").orderBy(order, "doc_id").limit(sample).union(train.filter("y = 1").orderBy(order, "doc_id").limit(sample))
    picked = F.broadcast(picked.select(F.col("doc_id").alias("_id"), "y"))  # no more than 2 * sample rows
    rows = docs.select("doc_id", F.struct(F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("data")).alias("t")).join(picked, F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("_id", "y").agg(F.min("t").alias("t"))
    rows = written(rows.select(F.xxhash64("_id", F.lit(11)).alias("h"), F.col("_id").alias("id"), "y", F.col("t.data").alias("data")), "quality-labelled")
    kind, halves = rows.schema["id"].dataType.simpleString(), rows.withColumn("build", F.pmod("h", F.lit(2)) == 0)
    share = {r["y"]: -(-BLOCKS // r["n"]) for r in halves.filter("build").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def measured(build: bool, measure, name: str, arrow: pa.DataType) -> list:
        half = halves.filter(F.col("build") == build).drop("build")
        return sorted(half.mapInArrow(_each(measure, arrow), f"h long, id {kind}, y int, x {name}").collect(), key=lambda r: r[:2])

    parts = measured(True, lambda data, y: blocks_of(data, share[y]), "array<binary>", pa.list_(pa.binary()))
    good, bad = ([bytes(x) for r in parts if r["y"] == y for x in r["x"] or ()] for y in (1, 0))
    if not good or not bad:
        return flat
    model = {"good": build_dictionary(good), "bad": build_dictionary(bad)}
    held = []

    def measure(data: bytes, _) -> float:
        if not held:
            held.append(Measure(model["good"], model["bad"]))
        return held[0](data)

    rest = measured(False, measure, "double", pa.float64())
    seen = sum(r["y"] for r in rest)
    if not 0 < seen < len(rest):
        return flat
    w0, w1 = calibrate(np.array([r["x"] for r in rest]), np.array([r["y"] for r in rest], float))
    return model | {"weights": (w0 + math.log(n[1] / n[0]) - math.log(seen / (len(rest) - seen)), w1)}


def score(model: dict, text: Column) -> Column:
    """The probability that the quality is 1, of the whole text alone; null and empty texts get that of a difference of 0."""
    (w0, w1), held = model["weights"], []

    @F.arrow_udf("double")
    def scores(data: pa.Array) -> pa.Array:
        if not held:
            held.append(Measure(model["good"], model["bad"]) if model["good"] else lambda data: 0.0)
        x = np.array([held[0](t.as_py() or b"") for t in data], float)
        return pa.array(1 / (1 + np.exp(-np.clip(w0 + w1 * x, -700, 700))), pa.float64())

    return scores(text.cast("binary"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text, ...).

    Whole texts are read, very long ones block by block.  Null and empty texts
    get the score of a size difference of 0; rows without a doc_id are scored
    and never held out; repeated rows score alike; other columns are not
    touched; an empty table gives no rows.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), score(fit(docs, labels), F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier predicts to be good; odd rows as in quality()."""
    rows = docs.select(F.struct("*").alias("row"), score(fit(docs, labels), F.col("text")).alias("score"))
    return rows.filter("score >= 0.5").select("row.*")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
