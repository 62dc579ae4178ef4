"""Corpus preparation: keep good documents, drop exact and near copies, mix sources and pack the rest into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import pipeline
from tidemark.llm.common import stored

#: (name, function) in order; a function takes (spark, docs, sf_dir) and returns the next stage's docs.
STAGES = [
    ("quality", pipeline.quality_stage),
    ("exact_dedup", pipeline.exact_dedup_stage),
    ("near_dedup", pipeline.near_dedup_stage),
    ("mixing", pipeline.mixing_stage),
    ("packing", pipeline.packing_stage),
]
#: The classifier, the fingerprints and the tokenizer are beyond SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
