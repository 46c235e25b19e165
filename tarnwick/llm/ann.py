"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Largest inner products are nearest neighbours in Euclidean distance once every
vector gets one more component that brings it to the longest one's norm (0 for
queries).  The vectors are dealt to lists around centroids, a query probes the
lists nearest to it, and within a list vectors are rotated at random and read
in blocks of columns: after d of D dimensions the distance so far estimates the
whole one, and a hypothesis test drops candidates that are too far to matter.
What is left is scored exactly on the original vectors, in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import matrix, usable
from .common import table, written

#: The centroids are fitted on SAMPLE vectors, or EACH for each of them where that is more, and there are at most MAX_LISTS of them.
SAMPLE, EACH, MAX_LISTS = 20_000, 8, 16_384
#: Vectors that every query is compared with before it probes.
PRIMER = 2048
#: Vectors that one task scans (neighbouring lists, or a part of a large one), and queries that it scans them for.
LIST_BLOCK, QUERY_BLOCK = 8192, 2048
#: Queries that a task scans for at a time: bounds the matrix of first partial distances.
SCAN_QUERIES = 256
#: Queries probe as many lists as gave this recall for TUNED vectors of the sample.
RECALL, TUNED = 0.97, 256
#: Columns read between tests, and the test's significance (larger: fewer wrong drops).
COLUMNS, EPSILON = 16, 2.1


def rotation(width: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def augment(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
    return np.column_stack([x, rest])


def centroids(x: np.ndarray, lists: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """k-means from a random start; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), lists, replace=False))].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many lists a query probes to find RECALL of its k nearest, measured on the (augmented) sample itself."""
    asked = sample[:TUNED].copy()
    asked[:, -1] = 0
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    home = np.concatenate([((centres**2).sum(1) - 2 * sample[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(sample), 4096)])
    score = asked @ sample.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort((centres**2).sum(1) - 2 * asked @ centres.T, axis=1), axis=1)
    found = np.sort(place[np.arange(len(asked))[:, None], home[top]].ravel())
    return int(found[min(len(found) - 1, int(RECALL * len(found)))]) + 1


def shelve(counts: np.ndarray, centres: np.ndarray, size: int) -> np.ndarray:
    """The shelf of each list: runs of lists along the centroids' main direction, of about `size` vectors or one list."""
    direction = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    shelf, held, number = np.zeros(len(centres), np.int32), 0, 0
    for i in np.argsort(centres @ direction, kind="stable"):
        if held and held + counts[i] > size:
            number, held = number + 1, 0
        shelf[i] = number
        held += counts[i]
    return shelf


def scan(queries: np.ndarray, vectors: np.ndarray, limit: np.ndarray, k: int, allowed: np.ndarray | None = None, epsilon: float = EPSILON, columns: int = COLUMNS):
    """Candidates of rotated queries among rotated vectors: positions (query, vector) of all that survive.

    limit: for each query, the squared distance beyond which nothing matters;
    it is lowered to the k-th nearest of the first vectors, measured in full.
    allowed: which vectors are in lists that a query probes (all, if none).
    """
    width, (nq, nv) = vectors.shape[1], (len(queries), len(vectors))
    head = min(nv, max(4 * k, 128))
    first = ((queries**2).sum(1)[:, None] + (vectors[:head] ** 2).sum(1) - 2 * queries @ vectors[:head].T).clip(0)
    if allowed is not None:
        first[~allowed[:, :head]] = np.inf
    if head >= k:
        limit = np.minimum(limit, np.partition(first, k - 1, axis=1)[:, k - 1])
    limit = limit * (1 + 1e-6) + 1e-6
    q0, v0 = np.nonzero(first <= limit[:, None])
    if head == nv:
        return q0, v0
    # The first column block is dense, so one product serves all pairs; later blocks read survivors only.
    cols = slice(0, min(columns, width))
    a, b = queries[:, cols], vectors[head:, cols]
    part = ((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T).clip(0)
    if allowed is not None:
        part[~allowed[:, head:]] = np.inf
    d = cols.stop
    reach = lambda d: limit * (d / width) * (1 + epsilon / math.sqrt(d)) ** 2 if d < width else limit
    qi, vi = np.nonzero(part <= reach(d)[:, None])
    part = part[qi, vi]
    while d < width and len(qi):
        cols = slice(d, min(d + columns, width))
        d = cols.stop
        keep_q, keep_v = [], []
        keep_p = []
        for s in range(0, len(qi), 65_536):
            qs, vs = qi[s : s + 65_536], vi[s : s + 65_536]
            p = part[s : s + 65_536] + ((queries[qs, cols] - vectors[head + vs, cols]) ** 2).sum(1)
            ok = p <= reach(d)[qs]
            keep_q.append(qs[ok])
            keep_v.append(vs[ok])
            keep_p.append(p[ok])
        qi, vi, part = map(np.concatenate, (keep_q, keep_v, keep_p))
    return np.concatenate([q0, qi]), np.concatenate([v0, vi + head])


def _top(qi: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best (score, then smaller id)."""
    order = np.lexsort((ids, -scores, qi))
    q = qi[order]
    start = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1)) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that are found for each row of queries, itself (its id) left out.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without an id; shorter vectors count as ending in zeros.
    Equal vectors are searched once, by their smallest id, and expand to their
    own ids at the end.  All rows are indexed; only the centroids are fitted on
    a bounded sample.  Of equal scores the smaller id comes first.  Columns of
    other names are not read.  An empty table or query set gives no rows.
    """
    spark = vectors.sparkSession
    zero = ~F.exists("vec", lambda x: x != 0)
    rows = written(usable(vectors, id_col, vec_col).filter(~zero).withColumn("vec", F.transform("vec", lambda x: x + 0.0)).distinct(), "ann-rows")
    asked = usable(queries, id_col, vec_col).filter(~zero).withColumn("vec", F.transform("vec", lambda x: x + 0.0)).distinct()
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    facts = rows.agg(F.max(norm).alias("longest"), F.max(F.size("vec")).alias("width")).first()
    width = max(facts["width"] or 1, asked.agg(F.max(F.size("vec"))).first()[0] or 1)
    longest = facts["longest"] or 1.0

    # Equal vectors: the first k + 1 ids are enough for any query.
    same = Window.partitionBy("vec").orderBy("id")
    copies = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    named = copies.groupBy("vec").agg(F.min("id").alias("vid"), F.sort_array(F.collect_set("id")).alias("ids"))
    named = written(named, "ann-distinct")
    wanted = written(asked.select(F.col("id").alias("query_id"), "vec"), "ann-queries")
    heads = written(wanted.groupBy("vec").agg(F.min("query_id").alias("qid")), "ann-heads")
    n = named.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)

    lists = min(MAX_LISTS, max(1, int(2 * math.sqrt(n))))
    sample = named.orderBy(F.xxhash64("vid"), "vid").limit(max(SAMPLE, EACH * lists)).select("vid", "vec").toArrow()
    # A query's nearest in the primer are found already, and bound its k-th nearest of all.
    primer_ids, primer_rows = sample["vid"].to_numpy()[:PRIMER], matrix(sample["vec"], width)[:PRIMER]
    sample = augment(matrix(sample["vec"], width), longest)
    lists = min(lists, max(1, len(sample) // EACH))
    centres = centroids(sample, lists)
    probes = min(lists, probes_needed(sample, centres, k))
    turn = rotation(width + 1)
    primer = sample[:PRIMER]

    def assign(batches):
        for b in batches:
            x = augment(matrix(b.column("vec"), width), longest)
            near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], [*b.schema.names, "list"])

    index = written(named.select("vid", "vec").mapInArrow(assign, "vid long, vec array<double>, list int"), "ann-index")
    counts = np.zeros(lists, np.int64)
    for r in index.groupBy("list").count().collect():
        counts[r["list"]] = r["count"]
    block = min(LIST_BLOCK, max(512, n // (2 * spark.sparkContext.defaultParallelism)))  # so that small tables keep all cores busy
    shelves = shelve(counts, centres, block)

    def probe(batches):
        for b in batches:
            x = np.column_stack([matrix(b.column("vec"), width), np.zeros(b.num_rows)])
            far = (centres**2).sum(1) - 2 * x @ centres.T
            near = np.argpartition(far, probes - 1, axis=1)[:, :probes]
            limit = np.full(b.num_rows, np.inf)
            if len(primer) > k:
                limit = np.partition(((x**2).sum(1)[:, None] + (primer**2).sum(1) - 2 * x @ primer.T).clip(0), k, axis=1)[:, k]
            at, shelf, named_lists = [], [], []
            for i, own in enumerate(near):
                for s in np.unique(shelves[own]):
                    at.append(i)
                    shelf.append(s)
                    named_lists.append(np.sort(own[shelves[own] == s]).astype(np.int32))
            take = pa.array(at, pa.int64())
            columns = [*(c.take(take) for c in b.columns), pa.array(limit).take(take), pa.array(shelf, pa.int32()), pa.array(named_lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "bound", "shelf", "lists"])

    def prime(batches):
        for b in batches:
            q, ids = matrix(b.column("vec"), width), b.column("qid").to_numpy()
            few = min(k + 1, len(primer_rows))
            near = np.argpartition(-(q @ primer_rows.T), few - 1, axis=1)[:, :few].ravel()
            at = np.repeat(np.arange(len(q)), few)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(primer_ids[near]), pa.array(np.einsum("ij,ij->i", q[at], primer_rows[near]))], ["qid", "vid", "score"])

    asks = written(heads.mapInArrow(probe, "vec array<double>, qid long, bound double, shelf int, lists array<int>"), "ann-probes")
    asked_of = {r["shelf"]: r["count"] for r in asks.groupBy("shelf").count().collect()}
    held = np.bincount(shelves, weights=counts)
    grid = [(int(s), max(1, -(-int(held[s]) // block)), -(-n // QUERY_BLOCK)) for s, n in asked_of.items()]
    if not grid:
        return spark.createDataFrame([], out)
    grid = F.broadcast(spark.createDataFrame(grid, "shelf int, nv int, nq int"))  # no more rows than MAX_LISTS
    shelf_of = F.broadcast(spark.createDataFrame([(i, int(s)) for i, s in enumerate(shelves)], "list int, shelf int"))
    part = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(shelf_of, "list").join(grid, "shelf").withColumn("v", part("vid", "nv")).withColumn("q", every("nq")).select("shelf", "v", "q", "vid", "list", "vec")
    right = asks.join(grid, "shelf").withColumn("q", part("qid", "nq")).withColumn("v", every("nv")).select("shelf", "v", "q", "qid", "vec", "bound", "lists")

    def scan_block(vs: pa.Table, qs: pa.Table) -> pa.Table:
        x, q = matrix(vs["vec"], width), matrix(qs["vec"], width)
        vid, qid = vs["vid"].to_numpy(), qs["qid"].to_numpy()
        ids, scores, asking = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if len(x) and len(q):
            own, home, bound = qs["lists"].combine_chunks(), vs["list"].to_numpy(), qs["bound"].to_numpy()
            rotated, turned = np.asfortranarray(augment(x, longest) @ turn), np.column_stack([q, np.zeros(len(q))]) @ turn
            found = []
            for s in range(0, len(q), SCAN_QUERIES):
                some = own.slice(s, SCAN_QUERIES)
                member = np.zeros((len(some), lists), bool)
                member[np.repeat(np.arange(len(some)), some.value_lengths().to_numpy()), some.flatten().to_numpy()] = True
                qi, vi = scan(turned[s : s + SCAN_QUERIES], rotated, bound[s : s + SCAN_QUERIES], k + 1, member[:, home])
                dots = [np.einsum("ij,ij->i", q[qi[t : t + 65_536] + s], x[vi[t : t + 65_536]]) for t in range(0, len(qi), 65_536)]
                dots = np.concatenate(dots) if dots else scores
                at = _top(qi, vid[vi], dots, k + 1)
                found.append((qid[qi[at] + s], vid[vi[at]], dots[at]))
            asking, ids, scores = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"qid": asking, "vid": ids, "score": scores})

    keys = ["shelf", "v", "q"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan_block, "qid long, vid long, score double")
    hits = hits.union(heads.mapInArrow(prime, "qid long, vid long, score double")).groupBy("qid", "vid").agg(F.max("score").alias("score"))
    first = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    hits = written(hits.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r"), "ann-hits")
    rows = hits.join(named.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    few = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    rows = written(rows.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1).drop("r"), "ann-named")
    named_queries = wanted.join(heads, "vec").select("query_id", "qid")
    rows = named_queries.join(rows, "qid").filter("vec_id != query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 20 = 0"))
