"""Operators that keep a key with very many rows from landing in one task."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one MAX_HOT-th of the rows, so there are fewer hot keys than this.
MAX_HOT = 1000


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 16, least: int = 10_000) -> DataFrame:
    """left joined to right on columns that both have (inner or left), hot keys of left spread over `salts` tasks each.

    Hot: more than `least` rows and more than one MAX_HOT-th of all; only their
    rows in right are repeated, once for each salt.  Their list is the one
    broadcast, of fewer than MAX_HOT rows however large left is.  Null keys
    match nothing and are spread likewise.  A row's salt is a hash of the whole
    row, so it is the same where a lost task is run again; rows equal in all
    columns share one.  Columns of the same name other than `on` are not
    allowed, nor maps in left.
    """
    if how not in ("inner", "left"):
        raise ValueError("inner or left: right's rows are repeated")
    null = reduce(Column.__or__, (F.col(c).isNull() for c in on))
    counts = left.filter(~null).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    floor = max(least, left.count() // MAX_HOT)
    hot = F.broadcast(counts.filter(F.col("_n") > floor).select(*on, F.lit(True).alias("_hot")))
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    l = left.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot") | null, spread).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r = right.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return l.join(r, [*on, "_salt"], how).drop("_salt")


def _folded(xs: np.ndarray, qs: np.ndarray, x_at: np.ndarray, q_at: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added up from the first component on: equal vectors have equal scores."""
    out = np.zeros(len(x_at))
    for x, q in zip(xs.T, qs.T, strict=True):
        out += x[x_at] * q[q_at]
    return out


def _nearest(xs: np.ndarray, ids: np.ndarray, qs: np.ndarray, asking: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of queries, positions of rows, scores): the k largest scores of each query, NaN first, smaller ids first among equals.

    A matrix product, whose rounding depends on the place in the matrix, only
    rules rows out, by a floor that lies under the k-th best by more than its
    error; the others' scores are those of _folded().
    """
    found = []
    with np.errstate(all="ignore"):
        size = lambda m: np.sqrt((m * m).sum(1))
        reach = size(xs[np.isfinite(xs).all(1)]).max(initial=0)
        for lo in range(0, len(qs), step):
            q = qs[lo : lo + step]
            rough = q @ xs.T
            sure = np.isfinite(rough)
            own = asking[lo : lo + step, None] == ids
            rough[~sure | own] = -np.inf
            floor = np.full(len(q), -np.inf)
            if len(ids) > k:
                slack = 8 * (xs.shape[1] + 2) * 2.0**-53 * reach * size(q) + 1e-300
                floor = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - np.where(np.isnan(slack), np.inf, slack)
            q_at, x_at = np.nonzero(((rough >= floor[:, None]) | ~sure) & ~own)
            score = _folded(xs, q, x_at, q_at)
            nan = np.isnan(score)
            order = np.lexsort((ids[x_at], -np.where(nan, 0, score), ~nan, q_at))
            q_at, x_at, score = q_at[order], x_at[order], score[order]
            first = np.searchsorted(q_at, q_at)
            keep = np.arange(len(q_at)) - first < k
            found.append((q_at[keep] + lo, x_at[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def block_search(vectors: DataFrame, queries: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """query_id, vec_id, score: the k largest inner products of each query among all vectors.

    vectors, queries: (id long, v array<double>).  Both sides are dealt to
    blocks, a cogroup for each pair of them, so nothing is broadcast and no
    group holds more than a block of about `block` vectors and one of half as
    many queries; it leaves k rows a query for the merge.  Ties go to the
    smaller id; a query's own id is left out.  Where a vector is null, holds a
    null or has another length than the query, the score is null and comes last.
    """
    from pyspark.sql.window import Window

    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n, m = vectors.count(), queries.count()
    rows, asks = max(1, -(-n // block), min(cores, n // 256)), max(1, -(-2 * m // block))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.filter("id IS NOT NULL").select("id", "v", part(rows).alias("r"), every(asks).alias("q"))
    right = queries.filter("id IS NOT NULL").select("id", "v", part(asks).alias("q"), every(rows).alias("r"))

    def held(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ChunkedArray]:
        """Ids, lengths (-1: null or with a null), the places of the components, and these."""
        v = side["v"].combine_chunks()
        nulls = np.zeros(len(v), bool)
        nulls[pc.list_parent_indices(v).to_numpy().astype(np.int64)[pc.is_null(v.flatten()).to_numpy(zero_copy_only=False)]] = True
        length = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(np.maximum(length, 0))))[:-1]
        return side["id"].to_numpy(), np.where(nulls, -1, length), starts, v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)

    def ask(xs: pa.Table, qs: pa.Table) -> pa.Table:
        (ids, x_size, x_from, x_flat), (asking, q_size, q_from, q_flat) = held(xs), held(qs)
        out = []
        for size in np.unique(q_size) if len(ids) else ():
            q, x = np.flatnonzero(q_size == size), np.flatnonzero((x_size == size) & (size >= 0))
            take = lambda flat, start: flat[start[:, None] + np.arange(size)]
            if len(x):
                q_at, x_at, score = _nearest(take(x_flat, x_from[x]), ids[x], take(q_flat, q_from[q]), asking[q], k)
                out.append((asking[q][q_at], ids[x][x_at], score, np.zeros(len(score), bool)))
            rest = np.sort(ids[np.setdiff1d(np.arange(len(ids)), x)])[: k + 1]
            out.append((np.repeat(asking[q], len(rest)), np.tile(rest, len(q)), np.zeros(len(q) * len(rest)), np.ones(len(q) * len(rest), bool)))
        query_id, vec_id, score, none = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in ("i8", "i8", "f8", bool))
        return pa.table({"query_id": query_id, "vec_id": vec_id, "score": pa.array(score, mask=none)})

    hits = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(ask, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.filter("vec_id != query_id").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def broadcast_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, which are counted first; beyond that as it is, for Spark to choose."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of equal key, and the rest of new added; new has one row a key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
