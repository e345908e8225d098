"""Persistence over consecutive windows and the cool-down that follows an emission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.operators import greedy
from tapline.session import materialise


def persistent_hits(windows: DataFrame, key: str = "src_ip", cfg: Config = DEFAULT,
                    score: str = "risk_score") -> DataFrame:
    """Add `hit_run`: whether the last n windows of the key all score high.

    A counter that resets on a low score has reached n exactly when the last n scores are high, so
    a frame of n rows replaces the running counter.
    """
    n = max(1, cfg.persistence_windows)
    w = Window.partitionBy(key).orderBy("window_end").rowsBetween(-(n - 1), 0)
    high = F.when(F.col(score) >= cfg.persistence_score, 1).otherwise(0)
    return windows.withColumn("hit_run", F.sum(high).over(w) == n)


def island_counts(windows: DataFrame, key: str = "src_ip", cfg: Config = DEFAULT,
                  score: str = "risk_score") -> DataFrame:
    """Add `consecutive`: the length of the current streak of high scores of the key."""
    w = Window.partitionBy(key).orderBy("window_end")
    resets = F.sum(F.when(F.col(score) < cfg.persistence_score, 1).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.when(F.col(score) >= cfg.persistence_score, 1).otherwise(0)
    inside = Window.partitionBy(key, "_streak").orderBy("window_end").rowsBetween(Window.unboundedPreceding, 0)
    return (windows.withColumn("_streak", resets)
            .withColumn("consecutive", F.sum(high).over(inside)).drop("_streak"))


def cooldown(hits: DataFrame, key: str = "src_ip", cfg: Config = DEFAULT) -> DataFrame:
    """The hits ``(key, window_end)`` that are emitted, each silencing its key for the cool-down."""
    return greedy.spaced(hits.select(key, "window_end"), [key], "window_end", cfg.cooldown_us)


def with_persistence(windows: DataFrame, key: str = "src_ip", cfg: Config = DEFAULT) -> DataFrame:
    """Add `persistent`: a run of high windows outside the key's cool-down.

    The windows are read twice, so they are stored first (one row per window).
    """
    marked = materialise(persistent_hits(windows, key, cfg), "persistence")
    return _with_emitted(marked, cooldown(marked.filter("hit_run"), key, cfg), key)


def _with_emitted(marked: DataFrame, emitted: DataFrame, key: str) -> DataFrame:
    return (marked.join(emitted.withColumn("_emit", F.lit(True)), [key, "window_end"], "left")
            .withColumn("persistent", F.coalesce("_emit", F.lit(False))).drop("_emit", "hit_run"))


def continued(windows: DataFrame, recent: DataFrame | None, emitted: DataFrame | None, due_us: int, key: str = "src_ip",
              cfg: Config = DEFAULT, score: str = "risk_score") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows with `persistent`, recent scores, newest emissions) where earlier windows left ``recent`` and ``emitted``.

    A key is remembered while one of its last windows scored high, or while its cool-down reaches past ``due_us``.
    """
    n = max(1, cfg.persistence_windows)
    scores = windows.select(key, "window_end", score)
    both = scores if recent is None else scores.unionByName(recent)
    marked = persistent_hits(both, key, cfg, score).select(key, "window_end", score, "hit_run")
    hits = marked.join(windows.select(key, "window_end"), [key, "window_end"], "left_semi").filter("hit_run").select(key, "window_end")
    chosen = cooldown(hits if emitted is None else hits.unionByName(emitted), key, cfg)
    out = _with_emitted(windows.withColumn("hit_run", F.lit(True)), chosen, key)
    newest_first = Window.partitionBy(key).orderBy(F.desc("window_end"))
    tail = both.withColumn("_r", F.row_number().over(newest_first)).filter(F.col("_r") < n)
    alive = tail.filter(F.col(score) >= cfg.persistence_score).select(key).distinct()
    last = chosen.groupBy(key).agg(F.max("window_end").alias("window_end")).filter(F.col("window_end") + cfg.cooldown_us > due_us)
    return out, tail.drop("_r").join(alive, key, "left_semi"), last


def emission_gate(windows: DataFrame) -> DataFrame:
    """Quiet levels pass only when persistent."""
    return windows.filter(~F.col("risk_level").isin("INFO", "LOW", "MEDIUM") | F.col("persistent"))
