"""Model branches on Spark ML and on aggregates: boosted trees, isolation forest, profile, calibration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.functions.math import bounded
from tapline.operators import reporting
from tapline.session import materialise

SAMPLE = 256


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Feature vector in the given order, missing values as zero.

    The assembler reads names with dots as paths, so columns enter under plain names.
    """
    from pyspark.ml.feature import VectorAssembler

    plain = {f"_f{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for i, c in enumerate(columns)}
    out = VectorAssembler(inputCols=list(plain), outputCol="features").transform(df.withColumns(plain))
    return out.drop(*plain)


def fit_boosted(train: DataFrame, columns: list[str], trees: int = 300, depth: int = 6, rate: float = 0.05,
                subsample: float = 0.9, seed: int = 42):
    """Gradient-boosted classifier with the classes weighted to balance."""
    from pyspark.ml.classification import GBTClassifier

    share = train.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    ratio = max(share.n, 1) / max(share.p, 1)
    rows = assembled(train, columns).withColumn("_w", F.when(F.col("label") == 1, F.lit(ratio)).otherwise(F.lit(1.0)))
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="_w", maxIter=trees, maxDepth=depth,
                         stepSize=rate, subsamplingRate=subsample, seed=seed).fit(rows)


def score_model(model, df: DataFrame, columns: list[str], out: str = "score") -> DataFrame:
    """Probability of the positive class, clipped to [0, 1]."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(assembled(df, columns))
    return scored.withColumn(out, bounded(F.element_at(vector_to_array("probability"), -1))).drop(
        "features", "rawPrediction", "probability", "prediction")


def cluster_signals(model, windows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Signals for windows a fitted model scores at or above the threshold."""
    columns = ["pps", "bps", "unique_dst_ports", "tcp_ratio", "udp_ratio", "syn_ratio", "mean_len", "iat_mean",
               "port_entropy"]
    hits = score_model(model, windows, columns, "ml_score").filter(F.col("ml_score") >= threshold)
    none = F.lit(None).cast("int")
    return hits.select(
        F.lit("ML_ANOMALOUS_CLUSTER").alias("category"), F.lit("Machine Learning").alias("detection_method"),
        F.lit("HIGH").alias("severity"), "src_ip", "dst_ip", none.alias("src_port"), none.alias("dst_port"),
        "protocol", F.concat(F.lit("Ensemble model scored "), F.round("ml_score", 4).cast("string"),
                             F.lit(" on real features")).alias("evidence"),
        F.round("ml_score", 4).alias("score"), F.col("last_us").alias("ts_us"),
        F.lit(0).cast("bigint").alias("event_id"), F.lit(31).alias("seq"))


# --- isolation forest -------------------------------------------------------------------------


def _harmonic(n: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _tree_samples(rows: DataFrame, row_id: str, trees: int, n: int, seed: int) -> DataFrame:
    """For each tree, the rows with the smallest seeded hashes; candidates are thinned by hash first."""
    from pyspark.sql import Window

    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 40)) / F.lit(float(1 << 40))
    per_tree = min(1.0, 4.0 * SAMPLE / max(n, 1))
    pool = min(1.0, per_tree * trees)
    picked = (rows.filter(unit(F.col(row_id), F.lit(seed)) < pool)
              .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
              .withColumn("_u", unit(F.col(row_id), F.col("tree"), F.lit(seed)))
              .filter(F.col("_u") < per_tree / pool))
    w = Window.partitionBy("tree").orderBy("_u", row_id)
    return picked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= SAMPLE)


def fit_isolation(normal: DataFrame, columns: list[str], row_id: str, trees: int = 100, seed: int = 42) -> dict:
    """Trees grown in parallel from at most 256 rows each; the forest has at most 511 nodes per tree."""
    n = normal.count()
    size = min(SAMPLE, n)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    xs = [f"_x{i}" for i in range(len(columns))]
    rows = normal.select(F.col(row_id).cast("bigint").alias("_id"),
                         *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(columns, xs)])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf.tree.iloc[0])
        rng = np.random.default_rng([seed, tree])
        data = pdf.sort_values("_r")[xs].to_numpy()
        nodes: list[tuple] = []
        todo = [(data, 0, -1, False)]
        while todo:
            part, depth, parent, right = todo.pop()
            here = len(nodes)
            varying = np.flatnonzero(np.ptp(part, axis=0)) if len(part) > 1 else []
            if depth >= limit or not len(varying):
                nodes.append((tree, here, parent, right, -1, 0.0, len(part), depth))
                continue
            f = int(rng.choice(varying))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            nodes.append((tree, here, parent, right, f, cut, len(part), depth))
            left = part[:, f] <= cut
            todo += [(part[left], depth + 1, here, False), (part[~left], depth + 1, here, True)]
        return pd.DataFrame(nodes, columns=["tree", "node", "parent", "is_right", "feature", "cut", "size", "depth"])

    schema = "tree int, node int, parent int, is_right boolean, feature int, cut double, size int, depth int"
    # Bounded by trees * (2 * 256 - 1) rows.
    table = (_tree_samples(rows, "_id", trees, n, seed).groupBy("tree").applyInPandas(grow, schema)).toPandas()
    forest = []
    for _, t in table.groupby("tree"):
        t = t.sort_values("node")
        child = np.full((len(t), 2), -1)
        for node, parent, right in zip(t.node, t.parent, t.is_right):
            if parent >= 0:
                child[parent, int(right)] = node
        leaf_path = t.depth.to_numpy() + _harmonic(t["size"].to_numpy())
        forest.append((t.feature.to_numpy(), t.cut.to_numpy(), child, leaf_path))
    model = {"columns": columns, "forest": forest, "norm": float(_harmonic(np.array([size]))[0]) or 1.0, "offset": -0.5}
    quiet = normal.select(isolation_anomaly(model).alias("a"))
    # A tenth of the training rows lie below the offset.
    q = reporting.exact_quantiles(quiet.select((-F.col("a")).alias("s")), "s", [0.10]).first()
    model["offset"] = float(q.value)
    return model


def isolation_anomaly(model: dict) -> Column:
    """2 ** (-mean path / expected path) per row; the forest travels with the function."""
    forest, norm = model["forest"], model["norm"]

    @F.pandas_udf("double")
    def run(xs: pd.DataFrame) -> pd.Series:
        data = xs.to_numpy()
        rows = np.arange(len(data))
        total = np.zeros(len(data))
        for feature, cut, child, path in forest:
            at = np.zeros(len(data), dtype=int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                r, a = rows[inner], at[inner]
                at[inner] = child[a, (data[r, f[inner]] > cut[a]).astype(int)]
            total += path[at]
        return pd.Series(np.power(2.0, -total / len(forest) / norm))

    return run(F.struct(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"x{i}")
                          for i, c in enumerate(model["columns"])]))


def isolation_score(model: dict) -> Column:
    """Anomaly in [0, 1]: one half at the offset, growing as rows get easier to isolate."""
    decision = -isolation_anomaly(model) - F.lit(model["offset"])
    return bounded(0.5 - decision * 2.0)


# --- profile and calibration ------------------------------------------------------------------


def fit_profile(train: DataFrame, columns: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Mean and deviation of every feature over the rows labelled normal."""
    row = profile(train, columns).first()
    return ({c: row[f"mean_{i}"] for i, c in enumerate(columns)}, {c: row[f"std_{i}"] for i, c in enumerate(columns)})


def profile(train: DataFrame, columns: list[str]) -> DataFrame:
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    return train.filter("label = 0").agg(
        *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(x)],
        *[(F.stddev_pop(c) + 1e-9).alias(f"std_{i}") for i, c in enumerate(x)])


def calibrate_steps(rows: DataFrame, raw: str = "raw", label: str = "label", steps: int = 300,
                    rate: float = 0.1, max_scores: int = 200_000) -> tuple[float, float]:
    """Sigmoid calibration by a fixed number of gradient steps from (1, 0).

    Counts per distinct score are summed in Spark. Up to ``max_scores`` of them are fitted on the driver; of more,
    every step sums all counts in Spark.
    """
    counts = materialise(rows.groupBy(F.col(raw).cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos")), "calibration")
    size = counts.agg(F.count(F.lit(1)).alias("scores"), F.sum("n").alias("n")).first()
    total, small = size.n or 0, size.scores <= max_scores
    if small:
        held = counts.toPandas().sort_values("x")
        x, n, pos = (held[c].to_numpy(float) for c in ("x", "n", "pos"))
    w, b = 1.0, 0.0
    for _ in range(steps if total else 0):
        if small:
            residual = n / (1.0 + np.exp(-np.clip(w * x + b, -30.0, 30.0))) - pos
            dw, db = (residual * x).sum(), residual.sum()
        else:
            z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("x") * F.lit(float(w)) + F.lit(float(b))))
            residual = F.col("n") / (1.0 + F.exp(-z)) - F.col("pos")
            dw, db = counts.agg(F.sum(residual * F.col("x")), F.sum(residual)).first()
        w, b = w - dw / total * rate, b - db / total * rate
    return round(float(w), 8), round(float(b), 8)


def calibrate_newton(rows: DataFrame, raw: str = "raw", label: str = "label", tolerance: float = 1e-10,
                     passes: int = 25) -> tuple[float, float]:
    """The optimum of the same likelihood by damped Newton steps, each one aggregate over the counts per distinct score.

    A pass sums loss, gradient and curvature. A step that raises the loss is halved. Separable scores have no optimum: the
    steps end with the passes.
    """
    counts = materialise(rows.groupBy(F.col(raw).cast("double").alias("x")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos")).filter("x IS NOT NULL"), "calibration")

    def sums(w: float, b: float) -> list[float] | None:
        z = F.col("x") * F.lit(float(w)) + F.lit(float(b))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        # log(1 + e^z) without overflow
        loss = F.col("n") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - F.col("pos") * z
        rest, curve = F.col("n") * p - F.col("pos"), F.col("n") * p * (F.lit(1.0) - p)
        row = counts.agg(F.sum(loss), F.sum(rest * F.col("x")), F.sum(rest), F.sum(curve * F.col("x") * F.col("x")),
                         F.sum(curve * F.col("x")), F.sum(curve)).first()
        return list(row) if row[0] is not None else None

    w, b, share = 0.0, 0.0, 1.0
    at = sums(w, b)
    if at is None:
        return 1.0, 0.0
    for _ in range(passes):
        loss, gw, gb, hww, hwb, hbb = at
        det = hww * hbb - hwb * hwb
        if det <= 1e-12 * max(hww * hbb, 1e-300):  # one score only: the bias alone can move
            dw, db = 0.0, gb / hbb if hbb else 0.0
        else:
            dw, db = (gw * hbb - gb * hwb) / det, (gb * hww - gw * hwb) / det
        tried = sums(w - share * dw, b - share * db)
        if tried[0] > loss + 1e-12 * abs(loss) and share > 1e-6:
            share /= 2.0
            continue
        w, b, at = w - share * dw, b - share * db, tried
        if share * max(abs(dw), abs(db)) <= tolerance * max(1.0, abs(w), abs(b)):
            break
        share = min(1.0, share * 2.0)
    return float(w), float(b)


def calibrate_optimum(rows: DataFrame, raw: str = "raw", label: str = "label") -> tuple[float, float]:
    """The converged optimum of the same likelihood, in a few passes."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=0.0, standardization=False,
                               maxIter=100).fit(assembled(rows, [raw]))
    return float(model.coefficients[0]), float(model.intercept)
