"""Mixing sources to target weights by entropy balancing.

The mix gives each document a rate: how often it is repeated.  Of all rates
between 0 and `cap` that meet the sources' token targets, those of the least
Kullback-Leibler divergence from one copy of every document are exponentially
tilted by the document's tokens,

    rate_i = min(cap, exp(tilt of its source * tokens_i / longest of its source))

and the tilts minimise a convex dual whose gradient is the tokens that the mix
takes less the target.  Each Newton step is one distributed aggregation over
cells of equal (source, size); targets, tilts and their brackets stay in tables
with a row for each source, and only sums over all sources reach the driver.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, placed, ranked, table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Relative distance from the target at which a source's tilt is done, and Newton steps at most (a step that leaves the bracket halves it).
TOLERANCE, ROUNDS = 1e-9, 80


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources(skey, source_size, ...) with a target each.

    In the order of skey they take the weights in turn and share `share` times
    all tokens; a target stops at `cap` times its source's size and the excess
    is shared anew among the others by weight, until none is above.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = written(placed(sources, "skey").withColumn("weight", F.get(turn, F.pmod("place", F.lit(len(weights))).cast("int"))).drop("place"), "mix-weights")
    total, unit = None, 0.0
    while True:
        full = F.col("weight") * unit > cap * F.col("source_size")
        sums = rows.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if total is None:
            total = share * (sums[0] or 0)
        free = sums[2] or 0.0
        nxt = (total - cap * (sums[1] or 0)) / free if free else unit
        if nxt <= unit:
            break
        unit = nxt
    return rows.withColumn("target", F.when(full, cap * F.col("source_size")).otherwise(unit * F.col("weight"))).drop("weight")


def rate(tilt: Column, size: Column, longest: Column, cap: float) -> Column:
    """The rate of a document: the tilted one, at most cap; 1 for one without tokens."""
    return F.least(F.lit(float(cap)), F.exp(tilt * size / longest))


def solve_tilts(cells: DataFrame, sources: DataFrame, cap: float = 2.0) -> DataFrame:
    """sources with the tilt of each.

    cells: skey, size, n (documents of that size).  sources: skey,
    source_size, shortest (above 0), longest, target.  A source without
    tokens, or whose target is cap times its size, needs no search.  The dual
    is separable, so each source has a Newton step of its own, on the logarithm
    of the tokens taken; sums are exact decimals, so reruns agree.
    """
    c = F.col
    # Every document's rate lies between 1 and that of the shortest at these ends.
    end = lambda ratio: F.log(ratio) * c("longest") / c("shortest")
    free = (c("source_size") > 0) & (c("target") < cap * c("source_size"))
    ratio = c("target") / c("source_size")
    state = sources.withColumns({
        "low": F.when(free, F.least(end(ratio), F.lit(0.0))),
        "high": F.when(free & (ratio > 1), end(F.lit(float(cap)))).when(free, F.lit(0.0)),
        "tilt": F.when(free, F.lit(0.0)).when(c("source_size") > 0, end(F.lit(float(cap)))).otherwise(0.0),
        "done": ~free,
    })
    state = written(state, "mix-tilts")
    for _ in range(ROUNDS):
        at = cells.join(state.filter("NOT done").select("skey", "tilt", "longest"), "skey")
        r, exact = rate(c("tilt"), c("size"), c("longest"), cap), lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
        taken = c("n") * c("size") * r
        slope = F.when(r < cap, taken * c("size") / c("longest")).otherwise(0.0)
        sums = at.groupBy("skey").agg(exact(taken).alias("taken"), exact(slope).alias("slope"))
        # Beyond a kink the slope may be 0 and the step null; the bracket's middle serves then.
        nxt = state.join(sums, "skey", "left").withColumns({
            "done": c("done") | (F.abs(c("taken") - c("target")) <= TOLERANCE * c("target")) | (c("low") >= c("high")),
            "low": F.when(c("taken") < c("target"), c("tilt")).otherwise(c("low")),
            "high": F.when(c("taken") > c("target"), c("tilt")).otherwise(c("high")),
        })
        step = c("tilt") + F.log(c("target") / c("taken")) * c("taken") / F.nullif(c("slope"), F.lit(0.0))
        inside = (step > c("low")) & (step < c("high"))
        nxt = nxt.withColumn("tilt", F.when(c("done"), c("tilt")).when(inside, step).otherwise((c("low") + c("high")) / 2)).drop("taken", "slope")
        state, old = written(nxt, "mix-tilts"), state
        discard(old)
        if state.filter("NOT done").isEmpty():
            break
    return state.drop("low", "high", "done")


def _round_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies for each cell of a source, largest sizes first: what rounding
    leaves over is carried to the next cell, so the source's words end within
    half its longest document of the target, and of many documents within about
    half its shortest."""
    pdf = pdf.sort_values("size", ascending=False)
    carry, out, counts = 0.0, [], pdf["n"].tolist()
    for size, n, rate, cap in zip(pdf["size"].tolist(), counts, pdf["rate"].tolist(), pdf["cap"].tolist(), strict=True):
        want = n * rate + (carry / size if size else 0.0)
        copies = int(min(max(math.floor(want + 0.5), 0), math.floor(n * cap)))
        carry += (n * rate - copies) * size
        out.append(copies)
    each = {"base": [c // n for c, n in zip(out, counts, strict=True)], "extra": [c % n for c, n in zip(out, counts, strict=True)]}
    return pdf[["skey", "size", "source_size", "target", "rate"]].assign(**each)


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Copies of every row of docs(doc_id, text, source, ...).

    Returns one row per row of docs: doc_id, text_hash (long, of the text),
    source, size, source_size, target, rate, copies, taken.  Null or wordless
    texts have size 0 and the rate 1, and take nothing; a very long text is one
    document like any other, and where a source has little else its words end
    as near the target as whole copies of it allow.  Null is a source of its
    own, after all others; rows without a doc_id and repeated rows count like
    any other; other columns are not read; an empty table gives no rows.
    Reruns on the same rows agree, but equal rows may swap their copies.  A
    source's distinct sizes (no more than its longest document has words) meet
    in one task; its documents do not.
    """
    skey = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))  # "-" comes after all others
    base = written(docs.select("doc_id", "source", skey.alias("skey"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    cells = written(base.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sources = cells.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("shortest"), F.greatest(F.max("size"), F.lit(1)).alias("longest"))
    tilts = solve_tilts(cells, source_targets(sources, weights, share, cap), cap)
    plan = cells.join(tilts, "skey").select("skey", "size", "n", "source_size", "target", F.round(rate(F.col("tilt"), F.col("size"), F.col("longest"), cap), 9).alias("rate"), F.lit(float(cap)).alias("cap"))
    plan = written(plan.groupBy("skey").applyInPandas(_round_cells, "skey string, size long, source_size long, target double, rate double, base long, extra long"), "mix-plan")
    copies = F.col("base") + (F.col("place") < F.col("extra")).cast("long")
    out = ranked(base, ["skey", "size"], ["doc_id", "text_hash"], "place").join(plan, ["skey", "size"])
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() says; rows equal in id, text and source share their copies."""
    per = mix(docs, **options).groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    per = written(per, "mix-copies")
    per = per.select(F.xxhash64("doc_id", "text_hash", "source").alias("_k"), F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), F.col("source").alias("_s"), "_sum", "_rows")
    # Each row travels as one struct, so that no column of docs can clash with those here.
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_hash"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"))
    rows = rows.withColumn("_key", F.xxhash64("_id", "_hash", "_source"))
    same = (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_h"))
    # The key alone deals the rows out; the rest only guards against its collisions.
    out = rows.join(per.filter("_sum > 0"), same)
    if not per.filter("_rows > 1").isEmpty():
        out = out.dropDuplicates(["_key", "_id", "_hash", "_source"])
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("_sum").cast("int")))).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
