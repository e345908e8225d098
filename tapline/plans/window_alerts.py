"""Window path: traffic to feature rows, scores, risk, persistence and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.operators import baseline, explain, extractor, features, intel, persistence, scoring
from tapline.session import materialise


def assessed_windows(df: DataFrame, cfg: Config = DEFAULT, group_cols: tuple[str, ...] = (), online: bool = True,
                     means: dict[str, float] | None = None, feature_rows: DataFrame | None = None,
                     extra_scores=None) -> DataFrame:
    """Feature rows with scores, fusion, protocol evidence and risk.

    ``means`` fixes the distance model's profile; ``online`` learns it from earlier windows;
    neither leaves it cold at zero. The online model scans the rows more than once, so they are
    stored first; there is one row per window, whatever the traffic.
    """
    f = feature_rows if feature_rows is not None else features.window_features(df, cfg, group_cols)
    if online and means is None:
        f = materialise(f, "features")
    if means is not None:
        return assessed(f, scoring.baseline_distance(means, features.NUMERIC_FEATURES), cfg, extra_scores)
    if not online:
        return assessed(f, None, cfg, extra_scores)
    f = f.join(baseline.online_distance(f, cfg, group_cols), [*group_cols, "window_end"])
    return assessed(f, F.col("kitsune"), cfg, extra_scores)


def assessed(f: DataFrame, kitsune: Column | None, cfg: Config = DEFAULT, extra_scores=None) -> DataFrame:
    """Scores, fusion, protocol evidence and risk over feature rows."""
    f = scoring.fuse(scoring.score(f, kitsune, extra_scores), cfg)
    return scoring.assess(features.with_protocol(f), cfg)


def flow_summary(assessed: DataFrame) -> DataFrame:
    """One row per processed window."""
    return assessed.select(
        F.col("last_us").alias("ts_us"), "src_ip", "dst_ip", "protocol", "packets", "bytes",
        F.col("risk_score").alias("anomaly_score"), "asset_id")


def window_alerts(assessed: DataFrame, verdicts: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Alerts for windows that pass the emission gate."""
    return alert_rows(persistence.with_persistence(assessed, "src_ip", cfg), verdicts, cfg)


def alert_rows(marked: DataFrame, verdicts: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Alerts for assessed windows that carry `persistent`."""
    w = explain.explain(persistence.emission_gate(marked))
    if verdicts is not None:
        w = intel.enrich_endpoints(w, verdicts)
    else:
        w = w.withColumn("threat_intel", F.struct(F.lit("clean").alias("status")))
    ident = F.sha2(F.concat_ws("|", F.lit("window"), F.col("window_end").cast("string"), "src_ip"), 256)
    return w.select(
        F.concat(F.lit("win_"), F.substring(ident, 1, 12)).alias("alert_id"),
        F.concat(F.lit("inc_"), F.substring(ident, 13, 12)).alias("incident_id"),
        F.col("last_us").alias("ts_us"), F.col("last_us").alias("first_us"), "last_us", "window_end",
        "src_ip", "dst_ip", F.col("first_src_port").alias("src_port"), F.col("first_dst_port").alias("dst_port"),
        "protocol", "asset_id", F.lit(cfg.asset_criticality).alias("asset_criticality"), "attack_category",
        "risk_score", "risk_level", "confidence", F.col("fusion.model_disagreement").alias("model_disagreement"),
        "model_scores", "protocol_evidence", "baseline_deviation",
        F.struct(*[F.col(f"`{c}`") for c in features.FEATURES if c not in ("src_port", "dst_port")])
        .alias("feature_values"),
        "top_features", "explanation", "threat_intel", "reasons", "persistent",
        F.lit("1.0.0").alias("feature_schema_version"), F.lit("Multi-Model AI & Anomaly").alias("detection_method"),
        F.lit("Investigate anomalous traffic burst and compare with baseline.").alias("recommended_action"))


def volume_anomalies(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Window-level signals of the moving baselines."""
    x = materialise(extractor.extract(df, cfg), "window-volumes")
    return baseline.volume_signals(x, baseline.evaluate(baseline.ewma(x, cfg), cfg))
