"""Ranked per-alert evidence: contributions of features to each model, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions.math import pin

# Explanation weights per model and feature. They differ from the scorers' weights.
WEIGHTS = {
    "xgboost": {"fan_out": 0.25, "baseline_deviation": 0.20, "protocol_anomaly_score": 0.20,
                "bytes_per_sec": 0.15, "lateral_movement_score": 0.15, "udp_burst_score": 0.05,
                "ip_spoofing_score": 0.20, "packet_alteration_score": 0.20},
    "lstm": {"iat_cv": 0.55, "baseline_deviation": 0.25, "periodicity_score": 0.20, "behavior_anomaly_score": 0.20},
    "fft": {"periodicity_score": 0.45, "new_ip_ratio": 0.30, "fan_out": 0.25},
    "kitsune": {"behavior_anomaly_score": 0.50, "baseline_deviation": 0.50},
    "isolation_forest": {"baseline_deviation": 0.40, "fan_out": 0.20, "protocol_anomaly_score": 0.20,
                         "udp_burst_score": 0.20},
}

# The scale that maps each feature to [-1, 1].
SCALES = {"fan_out": 10.0, "baseline_deviation": 2.0, "bytes_per_sec": 5000.0, "periodicity_score": 10.0,
          "new_ip_ratio": 0.5}

# Explanations are built before protocol evidence joins the feature row.
UNAVAILABLE = {"protocol_anomaly_score"}
TOP_PER_MODEL, TOP_OVERALL = 5, 10


def weight_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m, f, w, SCALES.get(f, 1.0)) for m, fs in WEIGHTS.items() for f, w in fs.items()],
        "model string, feature string, weight double, scale double")


def _weights() -> Column:
    """The weight table as one constant: model to (position, feature, weight, scale)."""
    entries = []
    for m, fs in WEIGHTS.items():
        entries += [F.lit(m), F.array(*[F.struct(
            F.lit(i).alias("pos"), F.lit(x).alias("feature"), F.lit(w).alias("weight"),
            F.lit(SCALES.get(x, 1.0)).alias("scale")) for i, (x, w) in enumerate(fs.items())])]
    return F.create_map(*entries)


def _features() -> list[str]:
    return list(dict.fromkeys(x for fs in WEIGHTS.values() for x in fs))


def _item(pos: Column, feature: Column, value: Column, contribution: Column) -> Column:
    return F.struct(
        (-F.abs(contribution)).alias("by"), pos.alias("pos"), feature.alias("feature"), value.alias("value"),
        contribution.alias("contribution"),
        F.when(contribution > 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction"))


def _ranked(items: Column) -> Column:
    """Largest magnitude first, ties in declaration order; zeros left out."""
    return F.array_sort(F.filter(items, lambda x: x["contribution"] != 0))


def _side(items: Column, positive: bool, k: int) -> Column:
    return F.slice(F.filter(items, lambda x: x["contribution"] > 0 if positive else x["contribution"] < 0), 1, k)


def explain(f: DataFrame) -> DataFrame:
    """Add `explanation`: per-model evidence and the combined top features of both signs.

    Weights are one constant map walked by higher-order functions, which keeps the expression small.
    """
    entries = [c for x in _features() for c in (F.lit(x), F.lit(0.0) if x in UNAVAILABLE else F.coalesce(
        F.col(f"`{x}`").cast("double"), F.lit(0.0)))]
    f = pin(f, {"_values": F.create_map(*entries)})
    value = lambda x: F.element_at("_values", x)

    def contribution(w: Column) -> Column:
        return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value(w["feature"]) / w["scale"])) * w["weight"], 6)

    f = pin(f, {"_models": F.transform_values(_weights(), lambda m, ws: _ranked(F.transform(
        ws, lambda w: _item(w["pos"], w["feature"], value(w["feature"]), contribution(w)))))})
    f = pin(f, {"_flat": F.flatten(F.map_values("_models"))})
    order = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(x).alias("feature")) for i, x in enumerate(_features())])
    f = pin(f, {"_all": _ranked(F.transform(order, lambda o: _item(
        o["pos"], o["feature"], value(o["feature"]),
        F.round(F.aggregate(F.filter("_flat", lambda x: x["feature"] == o["feature"]), F.lit(0.0),
                            lambda acc, x: acc + x["contribution"]), 6))))})
    out = pin(f, {"explanation": F.struct(
        F.lit("1.0.0").alias("schema_version"), F.lit("deterministic-fallback").alias("method"),
        F.transform_values("_models", lambda m, items: F.struct(
            F.lit("deterministic-fallback").alias("method"),
            F.round(F.element_at("model_scores", m), 6).alias("model_score"), items.alias("features"),
            _side(items, True, TOP_PER_MODEL).alias("top_positive"),
            _side(items, False, TOP_PER_MODEL).alias("top_negative"))).alias("models"),
        _side(F.col("_all"), True, TOP_OVERALL).alias("top_positive"),
        _side(F.col("_all"), False, TOP_OVERALL).alias("top_negative"))})
    return out.withColumn("top_features", F.col("explanation.top_positive")).drop("_values", "_models", "_flat", "_all")


def contributions(f: DataFrame, ids: list[str]) -> DataFrame:
    """Long form for analysis: features joined to the weight table, summed per feature, ranked per sign.

    The weight table has one row per (model, feature) and is broadcast.
    """
    from pyspark.sql import Window

    feats = [x for x in dict.fromkeys(feat for fs in WEIGHTS.values() for feat in fs) if x not in UNAVAILABLE]
    long = f.select(*ids, F.explode(F.array(*[F.struct(
        F.lit(x).alias("feature"), F.col(f"`{x}`").cast("double").alias("value")) for x in feats])).alias("e")
    ).select(*ids, "e.*")
    w = F.broadcast(weight_table(f.sparkSession))
    c = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / F.col("scale"))) * F.col("weight"), 6)
    summed = (long.join(w, "feature").withColumn("c", c).filter("c <> 0")
              .groupBy(*ids, "feature").agg(F.round(F.sum("c"), 6).alias("contribution")))
    sign = F.when(F.col("contribution") > 0, F.lit("positive")).otherwise(F.lit("negative"))
    win = Window.partitionBy(*ids, "direction").orderBy(F.desc(F.abs("contribution")), "feature")
    return (summed.filter("contribution <> 0").withColumn("direction", sign)
            .withColumn("position", F.row_number().over(win)).filter(F.col("position") <= TOP_OVERALL))
