"""Anomaly scorers, fusion and risk as column arithmetic over a feature row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.functions.math import bounded, dbl, let, norm, pin

MODELS = ["xgboost", "lstm", "fft", "kitsune", "isolation_forest"]


def tabular() -> Column:
    return bounded(0.25 * norm("fan_out", 10) + 0.20 * norm("baseline_deviation", 2)
                   + 0.20 * norm(_optional_protocol(), 1) + 0.15 * norm("bytes_per_sec", 5000)
                   + 0.15 * norm("lateral_movement_score", 1) + 0.05 * dbl("udp_burst_score")
                   + 0.10 * dbl("ip_spoofing_score") + 0.10 * dbl("packet_alteration_score"))


def sequence() -> Column:
    return bounded(0.40 * dbl("beacon_score") + 0.25 * norm("iat_cv", 1) + 0.20 * norm("baseline_deviation", 2)
                   + 0.15 * norm("periodicity_score", 5) + 0.15 * norm("behavior_anomaly_score", 1))


def spectral() -> Column:
    return bounded(0.50 * F.greatest(norm("periodicity_score", 5), dbl("beacon_score"))
                   + 0.25 * norm("new_ip_ratio", 0.5) + 0.25 * norm("fan_out", 10))


def isolation() -> Column:
    return bounded(0.4 * norm("baseline_deviation", 2) + 0.2 * norm("fan_out", 10)
                   + 0.2 * norm(_optional_protocol(), 1) + 0.2 * dbl("udp_burst_score")
                   + 0.15 * dbl("ip_spoofing_score") + 0.15 * dbl("packet_alteration_score"))


def _optional_protocol() -> Column:
    # Scorers run before the protocol evidence joins the feature row.
    return F.lit(0.0)


# The extension point for scorers: name to a function returning a Column over the feature row.
SCORERS: dict[str, Callable[[], Column]] = {
    "xgboost": tabular, "lstm": sequence, "fft": spectral, "isolation_forest": isolation,
}


def register_scorer(name: str, scorer: Callable[[], Column]) -> None:
    SCORERS[name] = scorer


def baseline_distance(means: dict[str, float], features: list[str]) -> Column:
    """Distance to a fixed profile of means: mean of |x - m| / (|m| + 1) over finite features."""
    terms, ones = [], []
    for c in features:
        x, m = dbl(f"`{c}`"), means.get(c)
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        t = F.abs(x - F.lit(m)) / F.lit(abs(m) + 1) if m is not None else F.lit(0.0)
        terms.append(F.when(ok, t).otherwise(F.lit(0.0)))
        ones.append(F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0)))
    n = sum(ones, F.lit(0.0))
    return bounded(F.when(n > 0, sum(terms, F.lit(0.0)) / n).otherwise(F.lit(0.0)))


def score(f: DataFrame, kitsune: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Add `model_scores`, a map from model to score. A cold distance model scores zero."""
    cols = {n: fn() for n, fn in SCORERS.items()}
    cols["kitsune"] = kitsune if kitsune is not None else F.lit(0.0)
    cols.update(extra or {})
    names = [m for m in MODELS if m in cols] + [m for m in cols if m not in MODELS]
    entries = [x for n in names for x in (F.lit(n), cols[n])]
    return pin(f.drop("model_scores"), {"model_scores": F.create_map(*entries)})


def fuse(f: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Weighted mean over the models present, with spread and agreement measures, as `fusion`."""
    clean = F.transform_values("model_scores", lambda k, v: bounded(v))
    f = pin(f, {"_clean": clean}).drop("model_scores").withColumnRenamed("_clean", "model_scores")
    s = F.col("model_scores")
    values = F.map_values(s)
    weights = cfg.fusion_weights
    has = {m: F.map_contains_key(s, m) for m in weights}
    total = sum((F.when(has[m], F.lit(w)).otherwise(F.lit(0.0)) for m, w in weights.items()), F.lit(0.0))
    weighted = sum((F.when(has[m], F.element_at(s, m) * w).otherwise(F.lit(0.0)) for m, w in weights.items()), F.lit(0.0))
    n = F.size(values)
    mean = F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(0.0))
    f = pin(f, {"_mean": mean})
    var = F.when(n > 1, F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
                 ).otherwise(F.lit(0.0))
    f = pin(f, {"_var": var})
    disagreement = F.least(F.lit(1.0), F.col("_var") * 4)
    return pin(f, {"fusion": F.struct(
        bounded(weighted / F.when(total == 0, F.lit(1.0)).otherwise(total)).alias("score"),
        F.col("_mean").alias("mean_score"), F.col("_var").alias("variance"),
        F.coalesce(F.array_max(values), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.array_min(values), F.lit(0.0)).alias("min_score"),
        disagreement.alias("model_disagreement"),
        F.greatest(F.lit(0.0), F.col("_mean") * (1 - disagreement)).alias("consensus_score"))}).drop("_mean", "_var")


def risk_score(cfg: Config = DEFAULT) -> Column:
    c = dbl
    capped = lambda name: F.least(F.lit(1.0), c(name) / 10.0)
    return F.least(F.lit(1.0), (
        F.col("fusion.score") * 0.75 + c("protocol_anomaly_score") * 0.45 + c("udp_burst_score") * 0.45
        + c("ttl_anomaly_score") * 0.35 + c("payload_integrity_anomaly") * 0.35 + c("ip_spoofing_score") * 0.45
        + c("packet_alteration_score") * 0.45 + c("beacon_score") * 0.50 + c("behavior_anomaly_score") * 0.25
        + capped("fan_out") * 0.30 + capped("port_diversity") * 0.15 + cfg.asset_criticality * 0.05))


def risk_level(cfg: Config = DEFAULT) -> Column:
    high = F.size(F.filter(F.map_values("model_scores"), lambda x: x >= 0.90))
    r = F.col("risk_score")
    return (F.when((r >= cfg.risk_critical) | (high >= 2), F.lit("CRITICAL"))
            .when(r >= cfg.risk_warning, F.lit("WARNING")).when(r >= cfg.risk_info, F.lit("INFO"))
            .otherwise(F.lit("LOW")))


# Reason texts with their condition, in output order.
REASONS = [
    ("fan_out > 5", "unusual destination fan-out"),
    ("baseline_deviation > 0.5", "behavior differs from baseline"),
    ("protocol_anomaly_score > 0", "protocol anomaly observed"),
    ("udp_burst_score >= 0.5", "high-rate UDP burst observed"),
    ("ttl_anomaly_score >= 0.5", "unexpected TTL variation observed"),
    ("payload_integrity_anomaly > 0", "payload integrity mismatch metadata observed"),
    ("ip_spoofing_score > 0", "source identity mismatch metadata observed"),
    ("packet_alteration_score > 0", "packet alteration or checksum mismatch metadata observed"),
    ("beacon_score >= 0.4", "periodic beaconing behavior observed"),
    ("behavior_anomaly_score >= 0.5", "packet behavior differs from the receive-side baseline"),
]

# Attack categories with their condition, first match wins.
CATEGORIES = [
    ("ip_spoofing_score > 0", "IP_SPOOFING"),
    ("packet_alteration_score > 0", "PACKET_ALTERATION"),
    ("udp_burst_score >= 0.5", "ABNORMAL_TRAFFIC_VOLUME"),
    ("beacon_score >= 0.4", "BEACONING"),
    ("ttl_anomaly_score >= 0.5", "TTL_ANOMALY"),
    ("payload_integrity_anomaly > 0", "PACKET_ALTERATION"),
    ("protocol_anomaly_score > 0", "PROTOCOL_ANOMALY"),
    ("fan_out > 5", "FAN_OUT_ANOMALY"),
    ("behavior_anomaly_score >= 0.5", "ABNORMAL_BEHAVIOR"),
]


def reasons() -> Column:
    return F.filter(F.array(*[F.when(F.expr(cond), F.lit(text)) for cond, text in REASONS]), lambda x: x.isNotNull())


def attack_category() -> Column:
    out = F.lit("NOVEL_BEHAVIOR")
    for cond, name in reversed(CATEGORIES):
        out = F.when(F.expr(cond), F.lit(name)).otherwise(out)
    return out


def assess(f: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add risk score, level, confidence, reasons and category to a fused feature row."""
    f = pin(f, {"risk_score": risk_score(cfg)})
    return f.withColumns({
        "risk_level": risk_level(cfg),
        "confidence": F.greatest(F.lit(0.0), 1.0 - F.col("fusion.model_disagreement")),
        "reasons": reasons(), "attack_category": attack_category(),
    })


def profile_distance(means: dict[str, float], scales: dict[str, float]) -> Column:
    """Offline profile score: mean of |x - mean| / scale over features, a fifth of it, clipped."""
    terms = [F.abs(dbl(f"`{c}`") - F.lit(m)) / F.lit(scales[c]) for c, m in means.items()]
    return bounded(sum(terms, F.lit(0.0)) / len(terms) / 5.0)


def row_robust_score(columns: list[str]) -> Column:
    """Mean of |x - median| over (MAD + std) across the features of one row, a third of it, clipped."""
    xs = F.array(*[dbl(f"`{c}`") for c in columns])
    k = len(columns)

    def median(arr: Column) -> Column:
        s = F.array_sort(arr)
        if k % 2:
            return F.element_at(s, k // 2 + 1)
        return (F.element_at(s, k // 2) + F.element_at(s, k // 2 + 1)) / 2.0

    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)

    def spread(arr: Column) -> Column:
        return let(total(arr) / k, lambda mean: F.sqrt(total(F.transform(arr, lambda x: (x - mean) * (x - mean))) / k))

    def score(arr: Column) -> Column:
        centred = let(median(arr), lambda med: F.transform(arr, lambda x: F.abs(x - med)))
        return let(centred, lambda c: let(spread(arr), lambda std: let(
            median(c) + std + 1e-9, lambda scale: total(F.transform(c, lambda x: x / scale)) / k / 3.0)))

    # every intermediate is bound once: written out, the expression would be evaluated per feature
    return bounded(let(xs, score))


def calibrated(raw: Column, weight: float, bias: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(weight) * raw + F.lit(bias))))
