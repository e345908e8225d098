"""Documents through toxicity, exact and near duplicates, mixing and tokenisation; each stage is written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapline.llm import stages
from tapline.session import scratch

STAGES = [
    ("toxicity", stages.without_toxic),
    ("exact_dedup", stages.without_copies),
    ("ngram_jaccard", stages.without_near_copies),
    ("mixing", stages.mixed),
    ("sentencepiece", stages.tokenised),
]
#: The model stages (trained scores, random splits, tokenizer files) have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
