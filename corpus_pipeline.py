"""From raw documents to packed training sequences, in four stages.

Each stage reads what the one before it wrote and returns the columns of
documents, further ones among them; the last returns the packed pieces.  Null
and empty texts, ties, repeated rows, rows without a doc_id, very long texts and
empty tables get what the stage's operator says of them: an empty text is
judged by the labels' shares alone, is a copy of every other text without
words, is taken once by the mix, and is packed as its closing id.  An empty
table gives no rows at any stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm import mixing, packing, quality, simhash
from tarnwick.llm.common import delete, scratch, shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each row judged by itself; it learns from the labelled ones among docs."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash candidates whose five-word Jaccard similarity is 0.8 or more.

    The smallest doc_id stays, rows without one last; repeated rows are one.
    op2_simhash's 3 bits are the contract of that query alone.
    """
    return simhash.without_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to twice, as whole rows."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; every row of docs is packed, repeated ones too."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: SQL has no tokenizer, no zstandard and no XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents.

    Every stage is written as Parquet in the shared folder and read again; then
    what it wrote on its way, and the stage before it, are deleted.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/pipeline-{i}-{uuid.uuid4().hex}"
            out.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
