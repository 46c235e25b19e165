"""Exact top-k by integer inner product, with MaxScore.

Every dimension is a term whose postings are the rows of a shard that have a
weight in it.  For a query, what a term can add to a score is bounded by its
largest weight in the shard.  Those of the smallest bounds whose sum stays
under the query's k-th best score so far are not essential: a row with nothing
but them cannot enter the result.  Essential postings are traversed first; the
k rows that lead then are scored in full, which raises the k-th best score, and
rows that may still compete are probed in the other terms, as long as they do.
The shards' results are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import best, matrix, usable
from .common import table, written

#: Rows of a shard, queries that one task asks it, and rows that prime each query's threshold.
SHARD, QUERY_BLOCK, PRIMER = 8192, 4096, 2048
#: Terms that competing rows are probed in between two checks.
PROBE = 8


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (id, vec array<long>): floor(scale * component) of every vector that has no null or non-finite component.

    A component that a long cannot hold then is refused: the query fails.
    """
    rows = usable(vectors, id_col, vec_col)
    held = lambda x: F.when(F.abs(x * scale) < float(1 << 63), F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a scaled component exceeds 64 bits")).cast("long"))
    return rows.select("id", F.transform("vec", held).alias("vec"))


class Shard:
    """A shard's postings: for each term the positions of its rows (None: most rows, so all are listed) and their weights, and its bounds, 0 included."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids, self.postings = rows, ids, []
        for column in rows.T:
            at = np.flatnonzero(column)
            self.postings.append((at, column[at]) if 2 * len(at) < len(column) else (None, np.ascontiguousarray(column)))
        self.low, self.high = rows.min(0, initial=0), rows.max(0, initial=0)


def maxscore(query: np.ndarray, shard: Shard, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, scores) of a query's k best rows of a shard (ids break ties), of those that score at least `floor`; and how many rows were probed."""
    bound = np.maximum(query * shard.low, query * shard.high)
    order = np.argsort(-bound, kind="stable")
    spare = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from each on can add
    cut = int(np.count_nonzero(spare[:-1] >= floor))
    partial = np.zeros(len(shard.rows), shard.rows.dtype)
    for term in order[:cut]:
        at, weights = shard.postings[term]
        if at is None:
            partial += query[term] * weights
        else:
            partial[at] += query[term] * weights
    alive = np.flatnonzero(partial + spare[cut] >= floor)
    if len(alive) > k:
        lead = alive[np.argpartition(-partial[alive], k - 1)[:k]]
        floor = max(floor, (partial[lead] + shard.rows[np.ix_(lead, order[cut:])] @ query[order[cut:]]).min())
        alive = alive[partial[alive] + spare[cut] >= floor]
    score, probed = partial[alive], len(alive)
    for i in range(cut, len(order), PROBE):
        terms = order[i : i + PROBE]
        score = score + shard.rows[np.ix_(alive, terms)] @ query[terms]
        keep = score + spare[min(i + PROBE, len(order))] >= floor
        alive, score = alive[keep], score[keep]
    keep = score >= floor
    alive, score = alive[keep], score[keep]
    at = best(score, shard.ids[alive], k)
    return alive[at], score[at], probed


def search(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest inner product for each query, itself (its id) left out.

    rows, queries: (id long, vec array<long>), as of quantised().  Ties go to
    the smaller id; rows equal in id and vector are one row; shorter vectors
    count as ending in zeros.  Scores are exact: in doubles where none can reach
    2^53, in 64-bit integers beyond; vectors whose scores could exceed these are
    refused.  Columns of other names are not read.  An empty table or query set
    gives no rows; fewer candidates than k are all returned.
    """
    spark = rows.sparkSession
    rows, asks = written(rows.distinct(), "topk-rows"), written(queries.distinct(), "topk-queries")
    sizes = F.transform("vec", lambda x: F.abs(x.cast("double")))
    total = F.aggregate(sizes, F.lit(0.0), lambda t, x: t + x)
    facts, wants = (df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("w"), F.max(F.array_max(sizes)).alias("most"), F.max(total).alias("sum")).first() for df in (rows, asks))
    if not facts["n"] or not wants["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(facts["w"], wants["w"], 1)
    reach = 1.001 * min((facts["most"] or 0) * (wants["sum"] or 0), (facts["sum"] or 0) * (wants["most"] or 0))
    if reach >= 1 << 62:
        raise ValueError("scores may exceed 64 bits")
    kind = np.float64 if reach < 1 << 53 else np.int64
    shards, blocks = max(-(-facts["n"] // SHARD), min(spark.sparkContext.defaultParallelism, -(-facts["n"] // 256))), -(-wants["n"] // QUERY_BLOCK)
    # The k + 1-th best of any rows is no more than that of all: a valid floor, itself among them.
    primer = matrix(rows.orderBy(F.xxhash64("id"), "id").limit(PRIMER).select("vec").toArrow()["vec"], width, kind)

    def prime(batches):
        for b in batches:
            x = matrix(b.column("vec"), width, kind)
            scores = x @ primer.T
            floor = np.partition(scores, len(primer) - k - 1, axis=1)[:, len(primer) - k - 1] if len(primer) > k else np.full(len(x), -(1 << 62))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor.astype(np.int64))], [*b.schema.names, "floor"])

    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("s", part(shards)).withColumn("q", every(blocks))
    asks = asks.mapInArrow(prime, "id long, vec array<long>, floor long")
    right = asks.withColumn("q", part(blocks)).withColumn("s", every(shards))

    def ask(xs: pa.Table, qs: pa.Table) -> pa.Table:
        ids, asking = xs["id"].to_numpy(), qs["id"].to_numpy()
        found = ([], [], [])
        if len(ids) and len(asking):
            held, q, floor = Shard(matrix(xs["vec"], width, kind), ids), matrix(qs["vec"], width, kind), qs["floor"].to_numpy()
            for i in range(len(q)):
                at, scores, _ = maxscore(q[i], held, k + 1, int(floor[i]))
                found[0].append(np.full(len(at), asking[i]))
                found[1].append(ids[at])
                found[2].append(scores)
        columns = [np.concatenate(f).astype(np.int64) if f else np.zeros(0, np.int64) for f in found]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    hits = left.groupBy("s", "q").cogroup(right.groupBy("s", "q")).applyInArrow(ask, "query_id long, vec_id long, score long")
    hits = hits.filter("vec_id != query_id").distinct()
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.filter("id % 20 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id != d.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
