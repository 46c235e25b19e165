"""Language identification by sparse multinomial logistic regression on character n-grams.

A text is lower-cased, everything but letters becomes a space, and n-grams of
one to ORDER characters, spaces at their ends only, are hashed.  Features are
TF-IDF: one plus the logarithm of the count, times the inverse document
frequency over all training documents, normalised to length one.  Weights are
learnt by follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties: the lasso part leaves only those hashes in the model that tell
languages apart.  A temperature, fitted to documents kept out of the training,
then calibrates the probabilities.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, table, written

#: Longest n-gram, bits of a hash, characters hashed at a time.
ORDER, HASH_BITS, BLOCK = 4, 16, 1 << 18
#: Bounds of the fit: documents of each language, and languages (the most frequent).
SAMPLE, LANGUAGES = 500, 512
#: FTRL-proximal: step sizes, lasso and ridge penalties, passes over the sample.
ALPHA, BETA, LASSO, RIDGE, EPOCHS = 1.0, 1.0, 0.01, 1e-3, 4
#: What is said of a text without letters.
UNKNOWN = "und"
_grams = None


class Grams:
    """Hashed character n-grams of texts, as (hash, count); made once, on the driver, and sent to the tasks (4 MB)."""

    def __init__(self):
        #: Each code point's lower case where that is one letter; a space for all that is no letter.
        self.letter = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                self.letter[c] = ord(low) if len(low) == 1 else c

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of the whole text, BLOCK characters at a time; what a block takes over from the one before it is counted once."""
        total, carry = 0, np.array([32], np.uint32)
        for at in range(0, len(text), BLOCK):
            c = self.letter[np.frombuffer(text[at : at + BLOCK].encode("utf-32-le"), np.uint32)]
            row = np.concatenate([carry, c, np.full(int(at + BLOCK >= len(text)), 32, np.uint32)])
            row = row[np.concatenate(([True], (row[1:] != 32) | (row[:-1] != 32)))]
            old, hashes = 0 if at == 0 else len(carry), []
            h, inner = np.zeros(len(row), np.uint64), np.ones(len(row), bool)
            for n in range(1, min(ORDER, len(row)) + 1):
                end = row[n - 1 :]  # the last characters of all n-grams
                h = h[: len(end)] * np.uint64(0x100000001B3) + end + np.uint64(n)
                if n > 2:
                    inner = inner[: len(end)] & (row[n - 2 : -1] != 32)
                keep = inner[: len(end)].copy() if n > 1 else end != 32
                keep[: max(old - n + 1, 0)] = False  # these end within the block before
                hashes.append(h[keep])
            h = np.concatenate([np.zeros(0, np.uint64), *hashes])
            h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
            total = total + np.bincount((h >> np.uint64(64 - HASH_BITS)).astype(np.int64), minlength=1 << HASH_BITS)
            carry = row[-(ORDER - 1) :]
        found = np.flatnonzero(total) if len(text) else np.zeros(0, np.int64)
        return found, total[found] if len(found) else found


def tfidf(found: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[found]
    return x / (np.sqrt(x @ x) or 1.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = ALPHA, beta: float = BETA, lasso: float = LASSO, ridge: float = RIDGE, epochs: int = EPOCHS, features: int = 1 << HASH_BITS) -> np.ndarray:
    """Weights (features + 1 x classes, the last row the bias) after `epochs` passes over rows (features, values), in their order.

    Each coordinate keeps the sum of its gradients, less what its steps have
    made of them (z), and of their squares (n); its weight follows from these
    alone: zero while |z| is within the lasso penalty.
    """
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(at):
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * lasso) / ((beta + np.sqrt(ns)) / alpha + ridge)
        return np.where(np.abs(zs) <= lasso, 0.0, w)

    for _ in range(epochs):
        for (found, x), label in zip(rows, y, strict=True):
            at, v = np.append(found, features), np.append(x, 1.0)
            w = weights(at)
            p = softmax(v @ w)
            p[label] -= 1
            g = np.outer(v, p)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(features + 1))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The t of the least mean log loss of softmax(scores / t), by golden sections of its logarithm; 1 without rows.

    Of m rows, a share of 1 / (m + 2) counts as of the other classes: m right
    answers do not prove that there are no wrong ones.
    """
    m, k = scores.shape
    if not m or k < 2:
        return 1.0
    want = np.full((m, k), 1 / (m + 2) / (k - 1))
    want[np.arange(m), y] = 1 - 1 / (m + 2)
    loss = lambda u: -(want * np.log(softmax(scores / math.exp(u)) + 1e-300)).sum(1).mean()
    low, high, ratio = -6.0, 6.0, (math.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def _of_texts(make):
    """A task's function: make(grams, batches)."""
    global _grams
    _grams = grams = _grams or Grams()

    def run(batches):
        yield from make(grams, batches)

    return run


def _frequencies(grams: Grams, batches):
    """Of each task: in how many texts each hash occurs, and the number of texts (hash -1)."""
    n, total = 0, np.zeros(1 << HASH_BITS, np.int64)
    for b in batches:
        for t in b.column(0):
            total[grams(t.as_py() or "")[0]] += 1
        n += b.num_rows
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["hash", "n"])


def _features(grams: Grams, batches):
    for b in batches:
        found = [grams(t.as_py() or "") for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([f for f, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["h", "lang", "hash", "n"])


def training(docs: DataFrame) -> DataFrame:
    """id, lang, text of the rows that may be learnt from: with a lang, and crc32(doc_id as text) mod 5 not 0."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.filter(F.col("lang").isNotNull() & ~held_out).select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> dict:
    """A model from training(docs): languages, idf, weights of the hashes that have any, bias, temperature.

    Document frequencies are those of all training documents.  Weights and
    temperature are learnt from at most `sample` documents with letters of each
    of the `languages` most frequent languages (ties by name), those of the
    smallest hash of id and text, so neither partitions nor the order of rows
    change them.  A fifth of the sample, by hash, is kept out of the training
    and calibrates; where that leaves a language without any, all train.  The
    driver gets a number for each hash and the sample's counts, never texts.
    """
    rows = training(docs)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = written(counts, "lang-counts")
    names = sorted(r["lang"] for r in counts.collect())
    seen = rows.select("text").mapInArrow(_of_texts(_frequencies), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).toArrow()
    df, n = np.zeros(1 << HASH_BITS), 0
    for h, c in zip(seen["hash"].to_numpy(), seen["n"].to_numpy()):
        if h < 0:
            n = int(c)
        else:
            df[h] = c
    idf = np.log((1 + n) / (1 + df)) + 1
    model = {"languages": names, "idf": idf, "at": np.zeros(0, np.int64), "weights": np.zeros((0, len(names))), "bias": np.zeros(len(names)), "temperature": 1.0}
    if not names:
        return model
    # A share of each language by hash comes first, so that no task ranks all of one; four times the sample, so that none falls short.
    hash_ = F.xxhash64("id", "text", F.lit(11))
    lettered = rows.filter(F.col("text").rlike(r"\p{L}")).withColumn("h", hash_)
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(4.0) * sample / F.col("n")).alias("share"))
    near = lettered.join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))  # at most `languages` rows
    near = written(near.select("h", "lang", "text"), "lang-near")
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    picked = near.select("h", "lang", "text").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= sample).drop("r")
    picked = picked.mapInArrow(_of_texts(_features), "h long, lang string, hash array<long>, n array<long>").toArrow()
    number = {name: i for i, name in enumerate(names)}
    # The order of training is that of a hash: languages alternate.
    order = sorted(range(picked.num_rows), key=lambda i: (picked["h"][i].as_py(), picked["lang"][i].as_py()))
    if not order:
        return model
    y = np.array([number[picked["lang"][i].as_py()] for i in order])
    x = []
    for i in order:
        found, count = (picked[c][i].values.to_numpy() for c in ("hash", "n"))
        x.append((found, tfidf(found, count, idf)))
    kept = np.array([picked["h"][i].as_py() // 7 % 5 == 0 for i in order])
    if set(y[~kept]) != set(y):
        kept[:] = False
    w = ftrl([r for r, k in zip(x, kept) if not k], y[~kept], len(names))
    at = np.flatnonzero(np.abs(w[:-1]).sum(1))
    model |= {"at": at, "weights": w[at], "bias": w[-1]}
    scores = np.array([_scores(model, *r) for r, k in zip(x, kept) if k]).reshape(-1, len(names))
    return model | {"temperature": temperature(scores, y[kept])}


def _scores(model: dict, found: np.ndarray, x: np.ndarray) -> np.ndarray:
    place = np.searchsorted(model["at"], found)
    place[place == len(model["at"])] = 0
    has = model["at"][place] == found if len(model["at"]) else np.zeros(len(found), bool)
    return x[has] @ model["weights"][place[has]] + model["bias"]


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from the whole text alone."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lettered = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))

    def guess(grams: Grams, batches):
        for b in batches:
            said, score = [], []
            for t, good in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                if not good or not model["languages"]:
                    said.append(UNKNOWN)
                    score.append(0.0)
                    continue
                found, count = grams(t.as_py())
                p = softmax(_scores(model, found, tfidf(found, count, model["idf"])) / model["temperature"])
                said.append(model["languages"][int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"), lettered.alias("lettered"))
    return rows.mapInArrow(_of_texts(guess), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs(doc_id, text, lang, ...).

    Whole texts are read, very long ones block by block.  A text that is null or
    has no letter is `und`, with a score of 0; so is every text where nothing
    could be learnt.  Of equally likely languages the first by name is taken.
    Rows without a doc_id are learnt from, predicted and never held out;
    repeated rows get the same prediction; other columns are not read; an empty
    table gives no rows.
    """
    docs = spread(docs.select("doc_id", "text", "lang"))
    return predict(docs, fit(docs, sample))


def op11_langid(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
