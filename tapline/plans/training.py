"""Train, calibrate, choose a threshold and report, per model branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.operators import metrics, models, reporting, scoring

BRANCHES = ("xgboost", "fft", "kitsune", "isolation_forest")


def evaluate(scored: DataFrame, threshold: float, label: str = "label", score: str = "score",
             row_id: str = "row_id") -> dict:
    """Quality of one scored set, every measure an aggregate."""
    c = metrics.confusion(scored, [], label, score, threshold).first()
    return {"precision": c.precision, "recall": c.recall, "f1": c.f1,
            "roc_auc": metrics.roc_auc(scored, label, score).first().roc_auc,
            "pr_auc": metrics.pr_auc(scored, label, score, row_id).first().pr_auc,
            "test_samples": scored.count(), "threshold": threshold}


def train_branch(branch: str, rows: DataFrame, columns: list[str], row_id: str = "row_id", seed: int = 42,
                 trees: int | None = None, calibration_steps: int | None = 300) -> dict:
    """``rows`` carry `split`, `label`, ``row_id`` and the feature columns."""
    part = {s: rows.filter(F.col("split") == s) for s in ("train", "calibration", "test")}
    weight, bias, threshold = 1.0, 0.0, 0.5
    extra: dict = {}
    if branch == "xgboost":
        fitted = models.fit_boosted(part["train"], columns, trees or 300, seed=seed)
        test = models.score_model(fitted, part["test"], columns)
    elif branch == "isolation_forest":
        fitted = models.fit_isolation(part["train"].filter("label = 0"), columns, row_id, trees or 100, seed)
        test = part["test"].withColumn("score", models.isolation_score(fitted))
    elif branch in ("kitsune", "fft"):
        if branch == "kitsune":
            means, stds = models.fit_profile(part["train"], columns)
            raw = scoring.profile_distance(means, stds)
            extra = {"baseline_means": means, "baseline_stds": stds}
        else:
            raw = scoring.row_robust_score(columns)
        cal = part["calibration"].withColumn("raw", raw)
        weight, bias = (models.calibrate_steps(cal, steps=calibration_steps) if calibration_steps
                        else models.calibrate_optimum(cal))
        prob = scoring.calibrated(F.col("raw"), weight, bias)
        threshold = metrics.best_threshold(cal.withColumn("score", prob)).first().threshold
        test = part["test"].withColumn("raw", raw).withColumn("score", prob)
    else:
        raise ValueError(f"unsupported model branch: {branch}")
    return {"status": "trained", "model_name": branch, "calibration": {"weight": weight, "bias": bias},
            "threshold": threshold, "metrics": evaluate(test, threshold, row_id=row_id), **extra}


def train_all(rows: DataFrame, columns: list[str], branches=BRANCHES, **options) -> dict:
    return {"status": "production_training", "feature_columns": columns, "rows": rows.count(),
            "models": {b: train_branch(b, rows, columns, **options) for b in branches}}


def harness(scored: DataFrame, label: str = "label") -> DataFrame:
    """Confusion at one half for every model and the fusion over labelled, scored windows."""
    long = scored.select(F.col(label).alias("label"), F.explode(F.map_concat(
        "model_scores", F.create_map(F.lit("fusion"), F.col("fusion.score")))).alias("model", "score"))
    out = metrics.confusion(long, ["model"], places=4)
    return out.withColumn("predicted_positive", F.col("tp") + F.col("fp"))


def latency(df: DataFrame, column: str) -> DataFrame:
    return reporting.exact_quantiles(df, column, [0.5, 0.95])
