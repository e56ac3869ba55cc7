"""From raw documents to shuffled shards, one written table a stage.

Every stage works on all rows that the one before it kept, and on whole texts.
For all stages: extra columns pass through whatever their names, an empty table
gives an empty table, and rows alike in every column are treated alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import decontam, minhash, mixing, quality, sharding
from tokenloom.llm.common import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (p < 0.5) go.

    Null and empty texts and texts without words have quality 0 and go. A null
    doc_id or source changes nothing: the text decides. Very long texts are
    pooled whole. Ties: a probability of exactly 0.5 stays. Repeated rows stay or
    go together. Without labels of both classes all documents with words stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least doc_id.

    Rows without a doc_id or text, and texts without words, are in no group and
    stay. Very long texts are compared whole. Repeated rows of the doc_id that
    stays all stay, as they are one document.
    """
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, with all rows of their doc_id.

    Rows without a doc_id or text stay, as do empty texts. Very long texts are
    searched whole. Ties: half of an item is enough. Null items, and items of
    fewer than two words, match nothing; without items all documents stay.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics.

    A null source or language is a category of its own; null and empty texts
    have no tokens and follow the probability of their cell, 0 if that has none.
    Very long texts count with all their tokens. Rows of one doc_id draw one
    number, as do all null ids.
    """
    return mixing.mix(docs).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets row_num, shard and slot.

    Null doc_ids come first in the numbering; null, empty and very long texts are
    rows like any other. Ties in doc_id are ordered by the other columns; rows
    alike in every column each get a number of their own.
    """
    return sharding.shard(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Trained weights and signatures are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1 and out.columns != docs.columns:
            raise ValueError(f"stage {name} changes the columns of documents")
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}-{name}")
    return docs
