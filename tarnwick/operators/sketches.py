"""Aggregates that merge: exact distinct counts as bitmaps, quantiles as KLL sketches, sets as theta sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.ordered import written
from tarnwick.sources.tables import scratch


def distinct_by_level(rows: DataFrame, place: DataFrame, key: str, value: str, levels: list[str]) -> DataFrame:
    """level, key, n: exact distinct numbers of `value` for each `key`, for each of the levels above it, and in all (level all, key null).

    value is a long; place(key, *levels) has one row a key, and each level lies
    within the next.  rows are read once: distinct pairs of key and value, few
    for each key, are counted as they are; of the first level on, a bitmap holds
    32,768 neighbouring values in 4 kB, and each coarser level merges the
    bitmaps of the one below.  So a level's work is bounded by its keys times
    the range of values over 32,768, whatever the rows.  Null values count
    nowhere; keys without a place count for themselves and in no level; a level
    that is null has a row of its own.
    """
    pairs = written(rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct(), "bitmap-pairs")
    out = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(key).alias("level"), F.col(key).cast("long").alias("key"), "n")
    # A bitmap for each key of the first level and bucket of values; those above carry their own level along.
    bits = pairs.join(place, key).groupBy(*levels, F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    for i, level in enumerate(levels):
        bits = written(bits, "bitmap-level")
        out = out.union(bits.groupBy(level).agg(F.sum(F.bitmap_count("bits")).alias("n")).select(F.lit(level), F.col(level).cast("long"), "n"))
        bits = bits.groupBy(*levels[i + 1 :], "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return out.union(bits.select(F.lit("all"), F.lit(None).cast("long"), F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))))


def store_quantiles(rows: DataFrame, by: list[str], value: str, k: int = 400) -> str:
    """Folder of Parquet files with a KLL sketch of `value` (a double) for each group: by, sketch, n.  Nulls and NaN take no part."""
    folder = scratch(rows.sparkSession, "kll-sketches")
    kept = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    kept.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n")).write.parquet(folder)
    return folder


def merged_quantiles(spark: SparkSession, folder: str, by: list[str], shares: list[float]) -> DataFrame:
    """by, n, share, quantile of stored sketches, merged over all other columns that they were kept by.

    With k of 400 a quantile's rank is off by less than 1 % of n with 99 %
    confidence; a value is always one of those seen, the smallest at share 0
    and the largest at 1.
    """
    merged = spark.read.parquet(folder).groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    each = merged.select(*by, "n", F.posexplode(F.kll_sketch_get_quantile_double("sketch", wanted)).alias("at", "quantile"))
    return each.select(*by, "n", F.get(wanted, F.col("at")).alias("share"), "quantile")


def set_counts(rows: DataFrame, by: list[str], value: str, flag: str, bits: int = 12) -> DataFrame:
    """by, yes, no, both, only_yes, only_no, either: estimated numbers of distinct values whose rows have the flag, do not, do at times, always, never, in all.

    One theta sketch a group and side; exact up to 2^bits values a sketch, and
    off by about 2^(-bits / 2) of the union beyond.  Rows with a null flag or
    value take no part; a side without rows counts 0.
    """
    kept = rows.filter(F.col(flag).isNotNull() & F.col(value).isNotNull())
    side = lambda on: F.theta_sketch_agg(F.when(F.col(flag) == on, F.col(value)), F.lit(bits))
    s = kept.groupBy(*by).agg(side(True).alias("y"), side(False).alias("n"))
    count = F.theta_sketch_estimate
    parts = {
        "yes": count("y"),
        "no": count("n"),
        "both": count(F.theta_intersection("y", "n")),
        "only_yes": count(F.theta_difference("y", "n")),
        "only_no": count(F.theta_difference("n", "y")),
        "either": count(F.theta_union("y", "n", F.lit(bits))),
    }
    return s.select(*by, *(c.alias(name) for name, c in parts.items()))
