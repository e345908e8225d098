"""Per-event detection: traffic to signals, incidents and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.operators import behaviors, correlate, intel, signatures
from tapline.schema import DEDUP_KEY


def dedup(df: DataFrame, streaming: bool = False) -> DataFrame:
    """Drop repeated events by their five-part identity.

    A batch keeps the first arrival, found by a combinable minimum rather than a sort per key.
    """
    if streaming:
        return df.dropDuplicatesWithinWatermark(["timestamp", "src_ip", "dst_ip", "protocol", "packet_len"])
    rest = [c for c in df.columns if c not in DEDUP_KEY]
    return (df.groupBy(*DEDUP_KEY).agg(F.min_by(F.struct(*rest), "event_id").alias("_r"))
            .select(*[F.col(c) if c in DEDUP_KEY else F.col(f"_r.{c}").alias(c) for c in df.columns]))


def signals(df: DataFrame, verdicts: DataFrame | None = None, cfg: Config = DEFAULT,
            extra: list[DataFrame] | None = None) -> DataFrame:
    """Union of signature, behaviour and reputation signals, plus any window-level signals given."""
    parts = [signatures.signature_signals(df), behaviors.behavioural_signals(df, cfg)]
    if verdicts is not None:
        parts.append(intel.intel_signals(df, verdicts))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts + (extra or []))


def alerts(df: DataFrame, verdicts: DataFrame | None = None, cfg: Config = DEFAULT,
           state: str = "first") -> DataFrame:
    return correlate.incident_alerts(correlate.incidents(signals(df, verdicts, cfg), cfg, state))
