"""Signals to incidents to alerts.

Signals of one (source, destination, category) that follow each other within the gap form one
incident. Signals are first reduced to one fragment per key and gap-long time bucket (two signals
in one bucket are never further apart than the gap), with map-side combine; only fragments are
ordered per key. A key that owns a third of all signals thus costs one row per bucket downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.functions.math import floor_div

KEY = ["src_ip", "dst_ip", "category"]

# Severities from rank 1 up.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def severity_rank(sev: Column) -> Column:
    found = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), sev)
    return F.when(found > 0, found).otherwise(F.lit(2)).cast("int")


def _order() -> Column:
    return F.struct("ts_us", "event_id", "seq")


def fragments(signals: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per key and gap-long bucket, with the incident it belongs to."""
    frag = (signals.withColumn("_bucket", floor_div(F.col("ts_us"), cfg.incident_gap_us))
            .groupBy(*KEY, "_bucket").agg(
                F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
                F.count(F.lit(1)).alias("event_count"),
                F.max(severity_rank(F.col("severity"))).alias("_rank"),
                F.array_sort(F.collect_set("detection_method")).alias("_methods"),
                F.min_by(F.struct("severity", "detection_method", "evidence", "protocol", "src_port",
                                  "dst_port", "event_id"), _order()).alias("_first")))
    w = Window.partitionBy(*KEY).orderBy("_bucket")
    opens = F.coalesce(F.col("first_us") - F.lag("last_us").over(w) > cfg.incident_gap_us, F.lit(True))
    start = F.last(F.when(opens, F.col("first_us")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    return frag.withColumn("_start", start).withColumn("incident_id", incident_id())


def incident_id() -> Column:
    return F.concat(F.lit("inc_"), F.substring(
        F.sha2(F.concat_ws("|", *KEY, F.col("_start").cast("string")), 256), 1, 12))


def incidents(signals: DataFrame, cfg: Config = DEFAULT, state: str = "final") -> DataFrame:
    """One row per incident.

    ``state="final"`` holds what the incident has grown to; ``state="first"`` is the row emitted at
    its first signal, which is never revised. ``signals`` may be their fragments, so that both states
    come from one table of fragments and no task sorts stored signals again.
    """
    parts = signals if "_start" in signals.columns else fragments(signals, cfg)
    merged = parts.groupBy("incident_id", *KEY, "_start").agg(
        F.max("last_us").alias("last_us"), F.sum("event_count").alias("event_count"),
        F.max("_rank").alias("_rank"),
        # Distinct method lists only: at most one per combination of methods.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_methods")))).alias("_methods"),
        F.min_by("_first", "first_us").alias("_first"))
    if state == "first":
        out = merged.select(
            "incident_id", *KEY, F.col("_start").alias("first_us"), F.col("_start").alias("last_us"),
            F.col("_first.severity").alias("max_severity"), F.lit(0.75).alias("confidence"),
            F.lit(1).cast("bigint").alias("event_count"),
            F.array("_first.detection_method").alias("detection_methods"), "_first")
    else:
        n = F.size("_methods")
        out = merged.select(
            "incident_id", *KEY, F.col("_start").alias("first_us"), "last_us",
            F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("_rank")).alias("max_severity"),
            F.when(F.col("event_count") == 1, F.lit(0.75))
            .otherwise(F.least(F.lit(0.99), F.lit(0.70) + F.lit(0.08) * n)).alias("confidence"),
            "event_count", F.col("_methods").alias("detection_methods"), "_first")
    return out.withColumns({
        "first_evidence": F.col("_first.evidence"), "trigger_protocol": F.col("_first.protocol"),
        "trigger_src_port": F.col("_first.src_port"), "trigger_dst_port": F.col("_first.dst_port"),
    }).drop("_first")


def incident_evidence(signals: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The first distinct evidence texts of each incident, in order of appearance.

    Texts are deduplicated per key and bucket before they move; the rank filter is applied per task
    before the final shuffle, so a long incident never gathers its texts in one place.
    """
    where = fragments(signals, cfg).select(*KEY, "_bucket", "incident_id")
    texts = (signals.filter("evidence <> ''")
             .withColumn("_bucket", floor_div(F.col("ts_us"), cfg.incident_gap_us))
             .groupBy(*KEY, "_bucket", "evidence").agg(F.min(_order()).alias("_at")))
    per_incident = (texts.join(where, [*KEY, "_bucket"])
                    .groupBy("incident_id", "evidence").agg(F.min("_at").alias("_at")))
    w = Window.partitionBy("incident_id").orderBy("_at", "evidence")
    top = per_incident.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cfg.incident_evidence)
    return top.groupBy("incident_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_n", "evidence"))), lambda x: x["evidence"]).alias("evidence"))


def recommended_action(category: Column) -> Column:
    """Advice by substring of the category; note that INSECURE_PROTOCOL contains OT."""
    return (F.when(category.contains("SCAN") | category.contains("SWEEP"),
                   F.lit("Verify authorization for scanning activity; block source IP if unapproved."))
            .when(category.contains("BEACON"),
                  F.lit("Inspect endpoint processes for active C2 communication or reverse shells."))
            .when(category.contains("OT"),
                  F.lit("CRITICAL: Check physical plant state immediately; verify PLC programming access."))
            .when(category.contains("MALICIOUS"),
                  F.lit("Block source IP at perimeter firewall and review external connection logs."))
            .otherwise(F.lit("Inspect source host and isolate network interface.")))


def incident_alerts(inc: DataFrame) -> DataFrame:
    """Alert rows from incidents, with identifiers derived from content."""
    methods = F.col("detection_methods")
    return inc.select(
        F.concat(F.lit("alt_"), F.substring(F.sha2(F.concat(F.lit("alert|"), "incident_id"), 256), 1, 12))
        .alias("alert_id"),
        "incident_id", F.col("first_us").alias("ts_us"), "first_us", "last_us", "src_ip", "dst_ip",
        F.col("trigger_protocol").alias("protocol"), F.col("trigger_src_port").alias("src_port"),
        F.col("trigger_dst_port").alias("dst_port"), F.col("category").alias("attack_category"),
        F.col("max_severity").alias("risk_level"),
        F.when(F.col("max_severity").isin("CRITICAL", "HIGH"), F.lit(0.85)).otherwise(F.lit(0.60)).alias("risk_score"),
        F.round("confidence", 3).alias("confidence"),
        F.when(F.size(methods) == 1, F.element_at(methods, 1)).otherwise(F.lit("Multiple Detection Methods"))
        .alias("detection_method"),
        methods.alias("all_detection_methods"), F.col("first_evidence").alias("evidence"), "event_count",
        recommended_action(F.col("category")).alias("recommended_action"))
