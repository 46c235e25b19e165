"""Operators on order that hold no group in one task: prefix sums, percentiles, ranks, joins on inequalities.

Rows are dealt to ranges of about `rows` rows along their order, written, and
sorted range by range; a window over one row a range and group adds up what
lies before.  Values are counted before they are dealt, so a heap of equal
values is one row, and ranges part rows that are equal in all columns by a
number of their own.  So neither a key with all rows nor a value with all rows
makes a task larger.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators.skew import salted_join
from tarnwick.sources.tables import scratch

#: Rows of a range.
ROWS = 1 << 18


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sorts(order: dict[str, bool]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order.items()]


def ranges(df: DataFrame, order: dict[str, bool], rows: int = ROWS) -> tuple[DataFrame, int]:
    """(df with _range, written: numbers of ranges of about `rows` rows that ascend along `order`, number of rows).

    order: columns and whether they ascend; nulls are the smallest values.  Rows
    equal in all of them may fall into several ranges only if other columns,
    named last in `order`, tell them apart.
    """
    source = written(df, "ordered-rows")
    n = source.count()
    dealt = source.repartitionByRange(max(1, -(-n // rows)), *_sorts(order))
    return written(dealt.withColumn("_range", F.spark_partition_id()), "ordered-ranges"), n


def prefixed(df: DataFrame, by: list[str], order: dict[str, bool], weight: str, rows: int = ROWS) -> DataFrame:
    """df with before (sum of `weight` over the rows of its key that come before it), place (their number), total and places (those of the whole key).

    df has one row for each key and value of the order columns; weights are
    longs.  Null keys are a key, null values the smallest.  No column of df is
    named before, place, total, places, _range or _key.
    """
    dealt, _ = ranges(df, {**dict.fromkeys(by, True), **order}, rows)
    dealt = dealt.withColumn("_key", F.struct(F.lit(0), *by))
    within = Window.partitionBy("_key", "_range").orderBy(*_sorts(order)).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_key", "_range").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    earlier, all_ = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_key")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = sums.select("_key", "_range", zero(F.sum("w").over(earlier)).alias("_w"), zero(F.sum("n").over(earlier)).alias("_n"), F.sum("w").over(all_).cast("long").alias("total"), F.sum("n").over(all_).cast("long").alias("places"))
    out = dealt.withColumns({"before": zero(F.sum(weight).over(within)), "place": zero(F.count(F.lit(1)).over(within))}).join(sums, ["_key", "_range"])
    return out.withColumns({"before": F.col("before") + F.col("_w"), "place": F.col("place") + F.col("_n")}).drop("_key", "_range", "_w", "_n")


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], rows: int = ROWS) -> DataFrame:
    """by, share, percentile: the exact percentiles of `value` in each group, interpolated between the two nearest values, all in one pass.

    Null values take no part, a group without any has no row; null keys are a
    group.  Any distribution of values will do: equal ones are counted before
    they meet, and different ones are dealt to ranges of `rows`.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    found = prefixed(counts, by, {"_v": True}, "_c", rows)
    at = F.col("share") * (F.col("total") - 1)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("_c"))
    hit = found.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).filter(holds(low) | holds(high))
    ends = hit.groupBy(*by, "share").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max(at - low).alias("part"))
    return ends.select(*by, "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("percentile"))


def ranks(df: DataFrame, by: list[str], order: dict[str, bool], rows: int = ROWS) -> DataFrame:
    """df with rank, dense_rank, percent_rank and cume_dist of its rows within their keys, as the window functions have them, and peers, total and row_number.

    row_number numbers rows that are equal in `order` in any order (but the
    same at every run on the same rows); ntile() of it is that of SQL.  Null
    keys are a key, null values the smallest.  Peers are counted before values
    are dealt to ranges of `rows`; rows get their numbers by a join in which
    values with very many rows are salted.
    """
    names = [*by, *order]
    counts = df.groupBy(*names).agg(F.count(F.lit(1)).alias("peers"))
    places = prefixed(counts, by, order, "peers", rows).select(F.struct(F.lit(0), *names).alias("_key"), "peers", "before", "place", "total")
    own = df.withColumn("_key", F.struct(F.lit(0), *names))
    out = written(numbered(own, ["_key"], "_peer", rows), "ordered-peers")
    out = salted_join(out, places, ["_key"])
    return out.select(
        *df.columns,
        (F.col("before") + 1).alias("rank"),
        (F.col("place") + 1).alias("dense_rank"),
        F.when(F.col("total") == 1, 0.0).otherwise(F.col("before") / (F.col("total") - 1)).alias("percent_rank"),
        ((F.col("before") + F.col("peers")) / F.col("total")).alias("cume_dist"),
        (F.col("before") + F.col("_peer") + 1).alias("row_number"),
        "peers",
        "total",
    )


def numbered(df: DataFrame, by: list[str], name: str, rows: int = ROWS) -> DataFrame:
    """df with a number from 0 for each row of its key, in no particular order: rows of one file split number on from those before."""
    salted = written(df.withColumns({"_split": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ordered-numbered")
    salted = salted.withColumn("_block", (F.col("_row").bitwiseAND((1 << 33) - 1) / rows).cast("int"))
    part = [*by, "_split", "_block"]
    counts = salted.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_split", "_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = salted.withColumn("_at", F.row_number().over(Window.partitionBy(*part).orderBy("_row")))
    return within.join(counts, part).withColumn(name, F.col("_base") + F.col("_at") - 1).drop("_split", "_block", "_row", "_base", "_at")


def ntile(n: int) -> Column:
    """Of the columns row_number and total: the tile, the first ones a row larger where they cannot be equal."""
    at, size, more = F.col("row_number") - 1, F.floor(F.col("total") / n), F.col("total") % n
    large = more * (size + 1)
    return F.when(at < large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - large) / F.greatest(size, F.lit(1)))).cast("int") + 1


def dominance(x: np.ndarray, asks: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each asking row: number and weight of the others that come later in the arrays and have a larger x.

    One pass for each bit of x's rank: rows that agree in all higher bits are
    brought together in their order, and those with the bit set are counted
    from the end for those without.
    """
    rank = np.unique(x, return_inverse=True)[1]
    n, total = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length()):
        order = np.argsort(rank >> bit + 1, kind="stable")
        group, one = (rank >> bit + 1)[order], (rank >> bit & 1)[order].astype(bool)
        counted = one & ~asks[order]
        last = np.searchsorted(group, group, "right")
        for out, w in ((n, np.ones(len(x), np.int64)), (total, weight)):
            before = np.concatenate(([0], np.cumsum(np.where(counted, w[order], 0))))
            out[order] += np.where(one, 0, before[last] - before[1:])
    return n * asks, total * asks


def _strip(along: str, across: str):
    """Of the rows of one strip, the asking ones with the counts of those that lie further along both columns."""

    def run(rows: pa.Table) -> pa.Table:
        a, b, asks, w = (rows[c].to_numpy(zero_copy_only=False) for c in (along, across, "asks", "weight"))
        order = np.argsort(a, kind="stable")
        n, total = dominance(b[order], asks[order], w[order])
        keep = asks[order]
        return pa.table({"id": rows["id"].to_numpy()[order][keep], "n": n[keep], "total": total[keep]})

    return run


def inequality_sums(left: DataFrame, right: DataFrame, on: list[tuple[str, str, str]], weight: str, rows: int = ROWS) -> DataFrame:
    """left with n (how many rows of right satisfy both inequalities) and total (the sum of right's column `weight`, a long, over them).

    on: two of (column of left, one of < <= > >=, column of right).  Pairs are
    never made, so the work grows with the rows, not with the result.  All rows
    are placed along both columns and cut into strips of about `rows`, or the
    root of their number if that is more; strips that lie beyond a row
    altogether add up from a grid of counts, whose cells are no more than the
    rows; the two strips that a row lies in are compared by themselves, each in
    one task.  Null values match nothing (n 0, total 0); ties follow the
    inequality; repeated rows count each; null weights count 0.  No column of
    left is named n or total.
    """
    if len(on) != 2 or any(op not in ("<", "<=", ">", ">=") for _, op, _ in on):
        raise ValueError("two inequalities, each one of < <= > >=")
    (lx, opx, rx), (ly, opy, ry) = on
    base = written(left.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "inequality-left")
    asking = base.select("id", F.lit(True).alias("asks"), F.col(f"row.{lx}").alias("x"), F.col(f"row.{ly}").alias("y"), F.lit(0).cast("long").alias("weight"))
    other = right.select(F.monotonically_increasing_id().alias("id"), F.lit(False).alias("asks"), F.col(rx).alias("x"), F.col(ry).alias("y"), F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("weight"))
    both = asking.union(other).filter("x IS NOT NULL AND y IS NOT NULL")
    for c, op in (("x", opx), ("y", opy)):
        # What satisfies the inequality comes after: at equal values, the asking row first if they may be equal.
        order = {c: op[0] == "<", f"tie{c}": True, "id": True}
        both, n = ranges(both.withColumn(f"tie{c}", F.col("asks") != F.lit("=" in op)), order, rows)
        width = max(rows, math.isqrt(n))
        within = Window.partitionBy("_range").orderBy(*_sorts(order))
        offset = both.groupBy("_range").agg(F.count(F.lit(1)).alias("k")).select("_range", F.coalesce(F.sum("k").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("k"))
        placed = both.withColumn("at", F.row_number().over(within)).join(F.broadcast(offset), "_range")  # a row for each range
        both = placed.withColumn(f"p{c}", F.col("at") + F.col("k") - 1).drop("_range", "at", "k", f"tie{c}")
    both = both.select("id", "asks", "weight", "px", "py", F.floor(F.col("px") / width).alias("i"), F.floor(F.col("py") / width).alias("j"))
    both = written(both, "inequality-places")
    # Within the strip i all that lies further on counts; within the strip j, only what lies in later strips i.
    found = both.groupBy("i").applyInArrow(_strip("px", "py"), "id long, n long, total long")
    found = found.union(both.groupBy("j").applyInArrow(_strip("py", "i"), "id long, n long, total long"))
    last = -(-n // width)
    cells = both.groupBy("i", "j").agg(F.count_if(~F.col("asks")).alias("n"), F.sum("weight").alias("w"))
    spark = left.sparkSession
    grid = spark.range(last).select(F.col("id").alias("i"), F.explode(F.expr(f"sequence(0L, {max(last - 1, 0)}L)")).alias("j"))
    beyond = lambda key, along: Window.partitionBy(key).orderBy(along).rowsBetween(1, Window.unboundedFollowing)
    sums = grid.join(cells, ["i", "j"], "left").fillna(0, ["n", "w"])
    for key, along in (("j", "i"), ("i", "j")):
        sums = sums.select("i", "j", *(F.coalesce(F.sum(c).over(beyond(key, along)), F.lit(0)).alias(c) for c in ("n", "w")))
    sums = written(sums, "inequality-grid")
    found = found.union(both.filter("asks").join(sums, ["i", "j"]).select("id", sums["n"], sums["w"]))
    found = found.groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return base.join(found, "id", "left").select("row.*", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "total")))
