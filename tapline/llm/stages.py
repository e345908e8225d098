"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns documents, the last one their tokens.

All but the last return the columns of ``docs``. An empty table passes through every stage; rows are judged one by
one, so repeated rows and null ids are kept or dropped by the rules of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.llm import chosen_path, exact_dedup, mixing, sentencepieces, toxicity
from tapline.llm.common import fitting, prepare, saved, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the rejection threshold; the classifier learns from the labelled training fold."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    chosen, _, index = toxicity.fit(docs, labels, toxicity.training_rows())
    score = toxicity.score_column(spark, chosen, index)
    return docs.filter(score(F.col("text")) < toxicity.REJECT)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal normalised texts."""
    prepare(spark)
    rows = exact_dedup.fingerprinted(docs, tuple(docs.columns))
    return exact_dedup.grouped(rows).filter("kept").select("_carry.*")


def _stamped(docs: DataFrame, purpose: str) -> DataFrame:
    """Rows as one struct column doc with a stored number _at."""
    return saved(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("_at")), purpose, "zstd")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate class."""
    prepare(spark)
    stamped = _stamped(docs, "near-docs")
    classes = chosen_path.near_duplicates(stamped.select("_at", "doc.doc_id", "doc.text"), uid="_at")
    dropped = saved(classes.filter(~F.col("first")).select(F.col("_uid").alias("_at")), "near-dropped")
    return stamped.join(fitting(dropped), "_at", "left_anti").select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix; a document appears once per epoch that takes it."""
    prepare(spark)
    stamped = _stamped(docs, "mix-docs")
    thin = stamped.select("doc.doc_id", "doc.source", "doc.text", "_at")
    taken = saved(mixing.repeated(mixing.mix(mixing.sized(thin, carry=("_at",)))), "mix-taken")
    return stamped.join(fitting(taken), "_at").select("doc.*")


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the other columns (but text and any named as the new ones), n_pieces and ids of every document."""
    prepare(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_pieces", "ids"))
    return sentencepieces.listed(sentencepieces.encoded(docs, sentencepieces.model_file(), carry=rest))
