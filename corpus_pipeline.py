"""Corpus pipeline: documents to token files, by five operators of lexisweave.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisweave.llm import pipeline_stages as stages
from lexisweave.llm.shared import materialize

STAGES = [
    ("quality", stages.quality),
    ("near_dedup", stages.near_dedup),
    ("decontaminate", stages.decontaminate),
    ("mixing", stages.mixing),
    ("tokens", stages.tokens),
]

#: The trained classifier, XXH64 and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
