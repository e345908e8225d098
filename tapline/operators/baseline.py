"""Moving baselines over the window series: EWMA z-scores and the online distance model.

The z-scores are linear recurrences, evaluated with chunked scans (ordered.py) rather than a fold over the
whole history of a metric; the distance model passes through tasks in chunks that begin with the history that still counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.operators import ordered
from tapline.operators.features import NUMERIC_FEATURES
from tapline.schema import SIGNAL_COLUMNS

# Metrics with a baseline, in reporting order.
TRACKED = ["pps", "bps", "unique_dst_ports", "syn_ratio", "rst_ratio", "burst_ratio"]
HOUR_US = 3_600_000_000
RANK_CHUNK_US = HOUR_US


def _ranked(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    work = df.withColumn("_hour", F.floor(F.col("window_end") / RANK_CHUNK_US))
    return ordered.rank(work, ["_hour"], ["window_end"], "obs", keys).drop("_hour")


def ewma(windows: DataFrame, cfg: Config = DEFAULT, scope: Column | None = None) -> DataFrame:
    """EWMA mean, variance, z-score and anomaly score per (scope, metric, window).

    The z-score compares with the mean after the update, and is rounded to two places once warm.
    """
    a, w = cfg.ewma_alpha, 1.0 - cfg.ewma_alpha
    base = windows.withColumn("scope", scope if scope is not None else F.lit("global"))
    base = _ranked(base.select("scope", "window_end", *[F.col(c).cast("double").alias(c) for c in TRACKED]), ("scope",))
    first = F.col("obs") == 1
    m = ordered.decayed(base, ("scope",), "obs", {
        f"_m_{c}": F.when(first, F.col(c)).otherwise(F.col(c) * a) for c in TRACKED}, w)
    step = {c: (F.col(c) - F.col(f"_m_{c}")) / w for c in TRACKED}  # distance to the mean before the update
    v = ordered.decayed(m, ("scope",), "obs", {
        f"_v_{c}": F.when(first, F.lit(1.0)).otherwise(w * a * step[c] * step[c]) for c in TRACKED}, w)
    v = v.select("scope", "window_end", "obs", F.explode(F.array(*[F.struct(
        F.lit(i).alias("pos"), F.lit(c).alias("metric"), F.col(c).alias("x"), F.col(f"_m_{c}").alias("mean"),
        F.col(f"_v_{c}").alias("variance")) for i, c in enumerate(TRACKED)])).alias("_e")).select(
        "scope", "window_end", "obs", "_e.*")
    z = F.when(first, F.lit(0.0)).otherwise(
        (F.col("x") - F.col("mean")) / F.sqrt(F.greatest(F.lit(1e-4), F.col("variance"))))
    v = v.withColumn("_z", z)
    warm = F.col("obs") >= cfg.ewma_warmup
    return v.withColumns({
        "zscore": F.when(warm, F.round("_z", 2)).otherwise(F.col("_z")),
        "anomaly_score": F.when(warm & (F.col("_z") > 0), F.round(1.0 / (1.0 + F.exp(-0.8 * (F.col("_z") - 3.0))), 4))
        .otherwise(F.lit(0.0)),
    }).drop("_z")


def evaluate(scores: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One verdict per (scope, window) over the six metrics."""
    text = F.format_string(
        "%s %s to %s (z=%s vs baseline mean %.1f)", "metric",
        F.when(F.col("zscore") >= cfg.zscore_critical, F.lit("spiked")).otherwise(F.lit("elevated")),
        F.col("x").cast("string"), F.col("zscore").cast("string"), "mean")
    flagged = F.when(F.col("zscore") >= cfg.zscore_flag, F.struct("pos", text.alias("t")))
    out = scores.groupBy("scope", "window_end").agg(
        F.max("anomaly_score").alias("composite_anomaly_score"),
        F.transform(F.array_sort(F.collect_list(flagged)), lambda s: s["t"]).alias("flagged_reasons"))
    return out.withColumn("is_anomaly", (F.col("composite_anomaly_score") >= cfg.composite_flag)
                          | (F.size("flagged_reasons") > 0))


def volume_signals(windows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Signals for anomalous windows; endpoints collapse to "multiple" when they differ."""
    hits = verdicts.filter("is_anomaly").join(windows, "window_end")
    return hits.select(
        F.lit("TRAFFIC_VOLUME_ANOMALY").alias("category"), F.lit("Anomaly Detection").alias("detection_method"),
        F.when(F.col("composite_anomaly_score") >= 0.85, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("severity"),
        "src_ip", "dst_ip", F.lit(None).cast("int").alias("src_port"), F.lit(None).cast("int").alias("dst_port"),
        "protocol", F.array_join("flagged_reasons", "; ").alias("evidence"),
        F.col("composite_anomaly_score").alias("score"), F.col("last_us").alias("ts_us"),
        F.lit(0).cast("bigint").alias("event_id"), F.lit(30).alias("seq")).select(*SIGNAL_COLUMNS)


def summary(scores: DataFrame, limit: int = 10) -> DataFrame:
    """Latest state of the first baselines, with the number of trackers."""
    state = scores.groupBy("scope", "metric").agg(
        F.min(F.struct("window_end", "pos")).alias("_since"),
        F.max_by(F.struct("obs", "mean", "variance"), "obs").alias("s"))
    trackers = state.agg(F.count(F.lit(1))).scalar()
    return state.orderBy("_since", "scope").limit(limit).select(
        F.concat_ws(":", "scope", "metric").alias("baseline"), F.col("s.obs").alias("count"),
        F.round("s.mean", 3).alias("mean"),
        F.round(F.sqrt(F.greatest(F.lit(1e-4), F.col("s.variance"))), 3).alias("std"),
        trackers.alias("active_metric_trackers"))


def online_distance(features: DataFrame, cfg: Config = DEFAULT, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Distance of each window to decayed feature means learned from the windows before it.

    Returns the window keys with `kitsune`; the first window scores zero.
    """
    return continued_distance(features, None, cfg, group_cols)[0]


def continued_distance(features: DataFrame, before: DataFrame | None, cfg: Config = DEFAULT, group_cols: tuple[str, ...] = (),
                       store: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(distances, means after the last window) of windows that follow the means ``before``.

    Means have one row per group with the newest `window_end`; they enter as a window of their own that comes first.
    The windows of a group (one row per slide, whatever the traffic) are cut into chunks by rank. A chunk also receives the
    windows before it, until what lies further back weighs less than 1e-24 of a mean, and passes through a task as
    a stream that holds one vector of means. ``store(rows, name)`` may write what both results read.
    """
    d = cfg.kitsune_decay
    ids = [*group_cols, "window_end"]
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in NUMERIC_FEATURES]).alias("x")
    rows = features.select(*ids, values, F.lit(False).alias("old"))
    if before is not None:
        rows = rows.unionByName(before.withColumn("old", F.lit(True)))
    reach = max(1, math.ceil(55 / -math.log(d))) if d > 0 else 1
    size = max(8192, 8 * reach)
    at = F.col("obs") - 1
    chunk = F.floor(at / size).cast("bigint")
    spills = at % size >= size - reach
    base = _ranked(rows, group_cols).withColumn("chunk", F.explode(F.when(spills, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    base = base.withColumns({"own": F.col("chunk") == chunk, "kitsune": F.lit(0.0)})
    keys = [*group_cols, "chunk"]
    base = base.withColumn("key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, means = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            null = np.asarray(batch.column("x").flatten().is_null()).reshape(n, -1)
            names, first = batch.column("key").to_pylist(), np.asarray(batch.column("obs")) == 1
            distance, after = np.zeros(n), np.zeros_like(x)
            for i in range(n):
                v = np.where(null[i], 0.0, x[i])
                if names[i] != key:
                    key, means = names[i], v.copy()
                else:
                    ok = np.isfinite(v) & ~null[i]
                    if ok.any():
                        terms = np.abs(v[ok] - means[ok]) / (np.abs(means[ok]) + 1.0)
                        distance[i] = min(1.0, max(0.0, np.nansum(terms) / ok.sum()))
                    means = d * means + (1.0 - d) * v
                if first[i]:
                    distance[i] = 0.0
                after[i] = means
            out = batch.set_column(batch.schema.get_field_index("x"), "x", pa.array(list(after), pa.list_(pa.float64())))
            yield out.set_column(out.schema.get_field_index("kitsune"), "kitsune", pa.array(distance))

    scanned = base.repartition(*keys).sortWithinPartitions("key", "obs").mapInArrow(run, base.schema)
    scanned = store(scanned.filter("own").select(*ids, "obs", "old", "kitsune", "x"), "distances")
    newest = scanned.groupBy(*group_cols).agg(F.max_by(F.struct("window_end", "x"), "obs").alias("_l"))
    return scanned.filter("NOT old").select(*ids, "kitsune"), newest.filter("_l IS NOT NULL").select(*group_cols, "_l.*")
