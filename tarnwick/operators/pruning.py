"""Joins that keep rows of the large side from being read or shuffled: by partitions at run time, and by a Bloom filter."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tarnwick.operators.ordered import written
from tarnwick.sources.tables import scratch


def partitioned(df: DataFrame, by: str) -> DataFrame:
    """df in a layout with a folder for each value of a column; a null has one, too."""
    folder = scratch(df.sparkSession, f"by-{by}")
    df.repartition(by).write.partitionBy(by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def runtime_filters(spark: SparkSession, least: str = "64m"):
    """Plans made within it send a Bloom filter of a join's small, filtered side to scans of at least so many bytes on the other side, before the shuffle."""
    held = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": least}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def filtered_join(large: DataFrame, small: DataFrame, condition, least: str = "64m") -> DataFrame:
    """The inner join, computed under runtime_filters() and written, as plans are made where they run."""
    with runtime_filters(large.sparkSession, least):
        return written(large.join(small, condition), "filtered-join")
