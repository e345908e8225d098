"""Labelled feature tables: contract-driven CSV reading, data gates, checksums, JSON rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.sources import files

MIN_ROWS = 20


class ContractError(ValueError):
    """A labelled dataset does not satisfy its contract."""


@dataclass(frozen=True)
class Contract:
    label: str = "label"
    timestamp: str | None = None
    group: str | None = None
    features: tuple[str, ...] = field(default_factory=tuple)
    sha256: str | None = None


def _number(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return (F.when(text.isin("true", "t"), F.lit(1.0)).when(text.isin("false", "f"), F.lit(0.0))
            .otherwise(F.trim(c).try_cast("double")))


def _columns(df: DataFrame, contract: Contract) -> list[str]:
    reserved = {contract.label, contract.timestamp, contract.group}
    missing = [c for c in [contract.label, contract.timestamp, contract.group, *contract.features]
               if c and c not in df.columns]
    if missing:
        raise ContractError(f"columns are absent: {missing}")
    features = list(contract.features) or [c for c in df.columns if c not in reserved]
    if not features:
        raise ContractError("no feature columns selected")
    return features


def gate_report(raw: DataFrame, contract: Contract) -> DataFrame:
    """Counts of contract violations in one pass over the raw text columns."""
    features = _columns(raw, contract)
    label = F.trim(F.col(f"`{contract.label}`")).try_cast("double")
    whole = F.when(label.isNotNull() & ~F.isnan(label), F.signum(label) * F.floor(F.abs(label)))
    nums = [_number(F.col(f"`{c}`")) for c in features]
    infinite = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    none, odd = F.lit(0), F.lit(0)
    for x in nums:
        none = none + F.when(x.isNull(), 1).otherwise(0)
        odd = odd + F.when(x.isNotNull() & infinite(x), 1).otherwise(0)
    return raw.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(whole.isNull()).alias("label_not_numeric"),
        F.count_if(whole.isNotNull() & ~whole.isin(0.0, 1.0)).alias("label_not_binary"),
        F.coalesce(F.sum(none), F.lit(0)).alias("feature_not_numeric"),
        F.coalesce(F.sum(odd), F.lit(0)).alias("feature_not_finite"),
        F.count_if(whole == 1).alias("positives"), F.count_if(whole == 0).alias("negatives"))


def check_gates(raw: DataFrame, contract: Contract) -> None:
    g = gate_report(raw, contract).first()
    for name in ("label_not_numeric", "label_not_binary", "feature_not_numeric", "feature_not_finite"):
        if g[name]:
            raise ContractError(f"{name}: {g[name]}")
    if g["rows"] < MIN_ROWS or not g["positives"] or not g["negatives"]:
        raise ContractError("at least 20 rows and both classes are required")


def typed(raw: DataFrame, contract: Contract) -> DataFrame:
    features = _columns(raw, contract)
    extra = []
    if contract.timestamp:
        extra.append(F.trim(F.col(f"`{contract.timestamp}`")).alias("time"))
    if contract.group:
        extra.append(F.trim(F.col(f"`{contract.group}`")).alias("group"))
    return raw.select(
        "row_id", F.trim(F.col(f"`{contract.label}`")).cast("double").cast("int").alias("label"), *extra,
        *[_number(F.col(f"`{c}`")).alias(c) for c in features])


def read_labelled(spark: SparkSession, path: str, contract: Contract) -> tuple[DataFrame, list[str]]:
    """Validated rows with `label`, `row_id` and the features; raises on any violation."""
    if contract.sha256:
        verify_checksum(spark, path, contract.sha256)
    raw = spark.read.option("header", True).csv(path)
    check_gates(raw, contract)
    # File splits are fixed, so a recomputed split numbers its rows alike.
    numbered = raw.withColumn("row_id", F.monotonically_increasing_id())
    return typed(numbered, contract), _columns(raw, contract)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file, of any size."""
    return files.digests(spark, path)


def verify_checksum(spark: SparkSession, path: str, expected: str) -> None:
    found = [r.sha256 for r in checksums(spark, path).select("sha256").distinct().take(2)]
    if found != [expected]:
        raise ContractError(f"checksum mismatch: expected {expected}, got {found}")


def rewrite_jsonl(spark: SparkSession, source: str, target: str) -> None:
    """Copy JSON feature rows, leaving out blank lines and normalising each document."""
    lines = spark.read.text(source).filter(F.trim("value") != "")
    lines.select(F.to_json(F.parse_json("value")).alias("value")).write.mode("overwrite").text(target)
