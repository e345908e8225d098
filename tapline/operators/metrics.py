"""Model quality measures over ``(label, score)`` rows, without pairwise work or a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.operators import ordered


def confusion(df: DataFrame, by: list[str], label: str = "label", score: str = "score",
              threshold: Column | float = 0.5, places: int = 6) -> DataFrame:
    pred, pos = F.col(score) >= threshold, F.col(label) == 1
    out = df.groupBy(*by).agg(
        F.count_if(pred & pos).alias("tp"), F.count_if(pred & ~pos).alias("fp"), F.count_if(~pred & pos).alias("fn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(
        F.col("tp") + F.col("fn"), F.lit(1))
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-12))
    return out.withColumns({"precision": F.round(p, places), "recall": F.round(r, places), "f1": F.round(f1, places)})


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Counts per distinct score, in descending chunks of a millionth of the unit range."""
    return (df.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
            .groupBy("s").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n"))
            .withColumn("_chunk", -F.floor(F.col("s") * 1_000_000)))


def cumulative(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """True and false positives at or above each distinct score."""
    return ordered.running_totals(_by_score(df, label, score), ["_chunk"], [F.desc("s")],
                                  {"tp": F.col("p"), "fp": F.col("n")})


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Probability that a positive outscores a negative, ties counting one half."""
    c = cumulative(df, label, score)
    # A negative at score s loses to the positives above s and half-loses to those at s.
    wins = F.sum(F.col("n") * (F.col("tp") - F.col("p") + 0.5 * F.col("p")))
    out = c.agg(wins.alias("w"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return out.select(F.coalesce(F.when((F.col("np") > 0) & (F.col("nn") > 0), F.round(
        F.col("w") / (F.col("np") * F.col("nn")), 6)), F.lit(0.0)).alias("roc_auc"))


def pr_auc(df: DataFrame, label: str = "label", score: str = "score", row_id: str = "row_id",
           id_chunk: int = 65_536) -> DataFrame:
    """Stepwise area under precision and recall; equal scores keep the order of their row id.

    Chunks are (score range, score, id range), so a score shared by a third of all rows is split.
    """
    rows = df.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"),
                     F.col(row_id).alias("r")).withColumns({
                         "_a": -F.floor(F.col("s") * 10_000), "_b": -F.col("s"), "_c": F.floor(F.col("r") / id_chunk)})
    one = F.lit(1).cast("bigint")
    ranked = ordered.running_totals(rows, ["_a", "_b", "_c"], ["r"], {
        "tp": F.when(F.col("y") == 1, one).otherwise(one * 0), "k": one})
    out = ranked.agg(F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("k"))).alias("area"),
                     F.count_if(F.col("y") == 1).alias("np"))
    return out.select(F.round(F.coalesce(F.col("area") / F.nullif(F.col("np"), F.lit(0)), F.lit(0.0)), 6)
                      .alias("pr_auc"))


# Thresholds tried besides the scores themselves.
EXTRA_THRESHOLDS = [0.05, 0.5, 0.95]


def best_threshold(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The candidate with the highest F1, the smallest among equals, from one cumulative pass.

    Candidates are the scores rounded to four places and three fixed values, so there are at most
    10,004 of them whatever the number of rows.
    """
    rows = df.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    spark = df.sparkSession
    fixed = spark.createDataFrame([(t,) for t in EXTRA_THRESHOLDS], "t double")
    cand = rows.select(F.round("s", 4).alias("t")).distinct().union(fixed).distinct()
    # A score counts for the thresholds at or below it: its largest grid point, or the one below
    # when rounding went up.
    grid = F.round("s", 4)
    at = F.when(grid <= F.col("s"), grid).otherwise(F.round(grid - 0.0001, 4))
    mass = rows.groupBy(at.alias("t")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n"))
    line = (cand.withColumn("cand", F.lit(True)).join(mass, "t", "full")
            .withColumns({"p": F.coalesce("p", F.lit(0)), "n": F.coalesce("n", F.lit(0)),
                          "_chunk": -F.floor(F.col("t") * 100)}))
    c = ordered.running_totals(line, ["_chunk"], [F.desc("t")], {"tp": F.col("p"), "fp": F.col("n")}).filter("cand")
    total = rows.agg(F.count_if(F.col("y") == 1)).scalar()
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(total, F.lit(1))
    f1 = F.round(2 * p * r / F.greatest(p + r, F.lit(1e-12)), 6)
    return c.select("t", f1.alias("f1")).agg(
        F.max_by("t", F.struct(F.col("f1"), (-F.col("t")).alias("low"))).alias("threshold"), F.max("f1").alias("f1"))
