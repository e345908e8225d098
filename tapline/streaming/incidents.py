"""Incidents on a stream of signals, as watermarked session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.operators.correlate import KEY, SEVERITIES, severity_rank


def incidents(signals: DataFrame, cfg: Config = DEFAULT, delay: str = "6 seconds") -> DataFrame:
    """One row per incident once the watermark passes its gap.

    ``signals`` carry `timestamp`. A gap of exactly the configured length still belongs to the
    incident, as in batch.
    """
    s = signals.withWatermark("timestamp", delay).groupBy(
        F.session_window("timestamp", f"{cfg.incident_gap_us} microseconds"), *KEY).agg(
        F.unix_micros(F.min("timestamp")).alias("first_us"), F.unix_micros(F.max("timestamp")).alias("last_us"),
        F.count(F.lit(1)).alias("event_count"), F.max(severity_rank(F.col("severity"))).alias("_rank"),
        F.array_sort(F.collect_set("detection_method")).alias("detection_methods"))
    return s.select(
        *KEY, "first_us", "last_us", "event_count",
        F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("_rank")).alias("max_severity"),
        "detection_methods",
        F.when(F.col("event_count") == 1, F.lit(0.75))
        .otherwise(F.least(F.lit(0.99), F.lit(0.70) + F.lit(0.08) * F.size("detection_methods"))).alias("confidence"))
