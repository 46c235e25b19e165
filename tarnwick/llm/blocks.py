"""Searches of a stated query set against all rows, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, vec array<double>) of the vectors that are not null and hold no null or non-finite component."""
    vec = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    return rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad))


def matrix(column, width: int, dtype=np.float64) -> np.ndarray:
    """A list column as a matrix; shorter rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width).astype(dtype)
    out = np.zeros((len(column), width), dtype)
    out[np.repeat(np.arange(len(ends)), ends), np.concatenate([np.arange(n) for n in ends]) if len(ends) else []] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids, in that order."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
