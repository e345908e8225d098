"""Tables the platform writes: append-only parquet by day, upserts resolved on read.

Appends never rewrite what is stored. A keyed table keeps every version and `latest` picks the last
one per key with a combinable aggregate. Streaming writers put each micro-batch in its own folder,
so a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.schema import FEEDBACK_LABELS


def _day(ts: str) -> Column:
    return F.date_format(F.timestamp_micros(F.col(ts)), "yyyy-MM-dd")


def append(df: DataFrame, path: str, ts: str | None = "ts_us", batch_id: int | None = None) -> None:
    """Append rows under day folders; ``batch_id`` makes the write repeatable."""
    if ts:
        df = df.withColumn("day", _day(ts))
    if batch_id is not None:
        df.write.mode("overwrite").partitionBy(*(["day"] if ts else [])).parquet(f"{path}/batch={batch_id}")
        return
    df.write.mode("append").partitionBy(*(["day"] if ts else [])).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows; columns added over time are merged, so the schema may only grow."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", False).parquet(path)


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The last written row per key."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), version).alias("_r"))
            .select(key, *[F.col("_r").getField(c).alias(c) for c in rest]))


def json_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as the stored alert schema has them."""
    nested = ("struct", "map", "array", "variant")
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in nested
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def evidence_rows(alerts: DataFrame) -> DataFrame:
    """The full JSON copy of each alert."""
    return alerts.select("alert_id", F.to_json(F.struct(*[F.col(f"`{c}`") for c in alerts.columns])).alias("evidence"),
                         "ts_us")


def save_alerts(alerts: DataFrame, path: str, batch_id: int | None = None) -> None:
    append(json_columns(alerts), f"{path}/alerts", "ts_us", batch_id)
    append(evidence_rows(alerts), f"{path}/alert_evidence", "ts_us", batch_id)


def save_flows(flows: DataFrame, path: str, batch_id: int | None = None) -> None:
    append(flows, f"{path}/flows", "ts_us", batch_id)


def save_features(features: DataFrame, path: str, batch_id: int | None = None) -> None:
    plain = features.select(*[F.col(f"`{c}`").alias(c.replace(".", "_").replace("-", "_")) for c in features.columns
                              if features.schema[c].dataType.typeName() not in ("variant",)])
    append(json_columns(plain), f"{path}/features", "last_us", batch_id)


def save_scores(assessed: DataFrame, path: str, batch_id: int | None = None) -> None:
    append(assessed.select("last_us", "window_end", F.col("model_scores").alias("scores")),
           f"{path}/model_scores", "last_us", batch_id)


def save_incidents(incidents: DataFrame, path: str, batch_id: int | None = None) -> None:
    append(incidents, f"{path}/security_incidents", "first_us", batch_id)


def upsert(df: DataFrame, path: str, version: int) -> None:
    """Add a version of keyed rows (assets, model versions); read back with `latest`."""
    df.withColumn("_version", F.lit(version).cast("bigint")).write.mode("append").parquet(path)


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    return latest(read(spark, path), key, "_version").drop("_version").orderBy(key)


def model_version_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Registry rows of trained branches; one per model name."""
    import json

    return spark.createDataFrame(
        [(e["model_name"], e.get("model_version", ""), e.get("feature_schema_version", "1.0.0"),
          json.dumps(e.get("provenance") or {}, sort_keys=True), json.dumps(e.get("metrics") or {}, sort_keys=True),
          json.dumps(e.get("hyperparameters") or {}, sort_keys=True)) for e in entries],
        "model_name string, model_version string, feature_schema_version string, training_dataset string, "
        "metrics string, hyperparameters string")


def feedback(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejects by the label domain."""
    ok = F.coalesce(F.col("label").isin(FEEDBACK_LABELS), F.lit(False))
    rows = df.withColumn("comment", F.coalesce("comment", F.lit("")))
    return rows.filter(ok), rows.filter(~ok)


def audit_rows(df: DataFrame, event: str, ts: str = "ts_us") -> DataFrame:
    return df.select(F.col(ts).alias("ts_us"), F.lit(event).alias("event"),
                     F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("data"))


def write_report(df: DataFrame, path: str) -> None:
    """A small aggregate as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
