"""A corpus pipeline: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Quality rules also take failed lines out of the texts that stay.

Null and empty texts are rejected by the quality rules. Rows without an id are judged by the first
two stages, link to nothing, and are packed. Rows that share an id are one document to the near-duplicate stage, and stay
or go together; rows with equal texts and different ids are copies, of which the smallest id
stays. Without labels no text counts as toxic. An empty table stays empty through all stages.
Very long texts are read whole. Further columns of documents, whatever their names, are carried
through to the packing stage, which returns pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from geoweft.llm import minhash, packing, quality, toxicity
from geoweft.llm.queries import END_ID, WINDOW, word_tokenizer
from geoweft.llm.textkit import documents
from geoweft.plans.lineage import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on labelled rows among what is left, so the network reads cleaned texts only."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and a similarity of 0.8; one document of each group stays."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_tokenizer(), WINDOW, END_ID)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]
#: The network and the packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage is written to the shared folder and read again as the next one's documents."""
    docs, base = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
