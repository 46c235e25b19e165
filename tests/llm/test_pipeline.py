"""The pipeline's stages against brute force on a small table, and on odd rows."""

import collections
import os

import corpus_pipeline as pipeline
from tarnwick.llm.common import shared_dir
from tests.llm.test_documents import frame, odd_rows
from tests.llm.test_neardup import brute_kept


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "mixing sources", "best-fit packing"]
    good = stages["quality classifier"](spark, docs, sf)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    rows = sorted(good.collect(), key=lambda r: r["doc_id"])
    kept = stages["SimHash near-dedup"](spark, good, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept([(r["doc_id"], r["text"]) for r in rows])
    mixed = stages["mixing sources"](spark, kept, sf)
    counts = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and max(counts.values()) <= 2
    packed = stages["best-fit packing"](spark, mixed, sf)
    assert collections.Counter(r["doc_id"] for r in packed.filter("piece = 0").collect()) == counts
    assert pipeline.run(spark, sf).count() == packed.count()


def test_run_on_odd_rows_leaves_no_scratch(spark, tmp_path):
    docs = frame(spark, odd_rows())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    out = pipeline.run(spark, str(tmp_path))
    assert out.filter("length > 1024").count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert len(set(os.listdir(shared)) - before) == 1
    for name, stage in pipeline.STAGES:
        rows = stage(spark, docs.limit(0), str(tmp_path))
        assert rows.count() == 0 and (name == "best-fit packing" or rows.columns == docs.columns)


def test_the_session_keeps_its_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    dict(pipeline.STAGES)["quality classifier"](spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001").count()
    assert spark.conf.get(key) == before
