import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import T0
from tapline.config import Config
from tapline.operators import baseline, greedy, integrity, metrics, models, ordered, persistence, reporting, scoring, splits
from tapline.plans import training


def test_running_totals_and_previous(spark):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("id")).withColumns({
        "v": F.col("id") % 7, "c1": F.floor(F.col("id") / 50), "c2": F.floor(F.col("id") / 10)})
    got = ordered.running_totals(df, ["c1", "c2"], ["id"], {"s": F.col("v")}).orderBy("id").collect()
    assert [r.s for r in got] == list(np.cumsum([i % 7 for i in range(200)]))
    sparse = df.filter("id % 50 > 20")
    prev = {r.id: r.p for r in ordered.previous(sparse, "c2", "id", {"p": "id"}).collect()}
    ids = [i for i in range(200) if i % 50 > 20]
    assert prev == {b: a for a, b in zip([None, *ids], ids)}


@pytest.mark.parametrize("decay", [0.9, 0.5, 0.999, 0.9995, 0.05, 1e-7])
def test_decayed_scan_equals_the_recurrence(spark, decay):
    x = np.random.default_rng(1).normal(size=5000)
    df = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(x)], "r long, x double")
    got = [r.y for r in ordered.decayed(df, (), "r", {"y": F.col("x")}, decay).orderBy("r").collect()]
    y, expect = 0.0, []
    for v in x:
        y = decay * y + v
        expect.append(y)
    assert got == pytest.approx(expect, abs=1e-9)


def test_decayed_scan_keeps_all_history(spark):
    df = spark.range(1, 20_001).withColumn("x", F.lit(1.0))
    last = ordered.decayed(df, (), "id", {"y": F.col("x")}, 0.9995).orderBy(F.desc("id")).first().y
    assert last == pytest.approx((1 - 0.9995 ** 20_000) / 0.0005, rel=1e-9)


def _volumes(spark, rows):
    cols = ["window_end", *baseline.TRACKED]
    return spark.createDataFrame([(T0 + i * 1_000_000, *r) for i, r in enumerate(rows)],
                                 ", ".join(f"{c} {'long' if c == 'window_end' else 'double'}" for c in cols))


def test_spike_after_steady_windows_flags(spark):
    x = _volumes(spark, [(10.0, 8000.0, 2.0, .1, 0.0, 1.0)] * 25 + [(500.0, 500000.0, 50.0, .9, .8, 5.0)])
    v = baseline.evaluate(baseline.ewma(x)).orderBy("window_end").collect()
    assert not any(r.is_anomaly for r in v[:25])
    assert v[25].is_anomaly and "bps elevated" in " ".join(v[25].flagged_reasons)


def _labelled(n, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    s[: n // 3] = 0.5  # a third of all rows share one score
    return y, s


def _scored(spark, y, s):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                                 "row_id long, label int, score double")


def test_rank_metrics_equal_brute_force(spark):
    y, s = _labelled(300)
    df = _scored(spark, y, s)
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(auc, abs=1e-6)
    order = sorted(range(len(s)), key=lambda i: -s[i])
    tp = area = 0
    for k, i in enumerate(order, 1):
        if y[i]:
            tp += 1
            area += tp / k
    assert metrics.pr_auc(df, id_chunk=16).first().pr_auc == pytest.approx(area / y.sum(), abs=1e-6)

    def f1(t):
        p = s >= t
        a, b, c = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
        pr, rc = a / max(a + b, 1), a / max(a + c, 1)
        return round(2 * pr * rc / max(pr + rc, 1e-12), 6)

    best = max(sorted({0.05, 0.5, 0.95, *np.round(s, 4)}), key=lambda t: (f1(t), -t))
    got = metrics.best_threshold(df).first()
    assert got.threshold == pytest.approx(best) and got.f1 == pytest.approx(f1(best))


def test_threshold_with_unrounded_scores(spark):
    y, s = _labelled(200, 9)
    s = np.clip(s + np.random.default_rng(2).uniform(-4e-3, 4e-3, len(s)), 0, 1)

    def f1(t):
        p = s >= t
        a, b, c = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
        pr, rc = a / max(a + b, 1), a / max(a + c, 1)
        return round(2 * pr * rc / max(pr + rc, 1e-12), 6)

    best = max(sorted({0.05, 0.5, 0.95, *np.round(s, 4)}), key=lambda t: (f1(t), -t))
    got = metrics.best_threshold(_scored(spark, y, s)).first()
    assert got.f1 == pytest.approx(f1(best)) and got.threshold == pytest.approx(best)


def test_degenerate_classes(spark):
    df = _scored(spark, np.ones(5, int), np.linspace(0, 1, 5))
    assert metrics.roc_auc(df).first().roc_auc == 0.0
    none = _scored(spark, np.zeros(5, int), np.linspace(0, 1, 5))
    assert metrics.pr_auc(none).first().pr_auc == 0.0


def test_quantiles_interpolate(spark):
    x = np.random.default_rng(4).gamma(2.0, size=501)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = {r.q: r.value for r in reporting.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    assert got == pytest.approx({q: float(np.percentile(x, q * 100)) for q in got})


def test_splits(spark):
    df = spark.range(30).select(F.col("id").alias("row_id"), (F.col("id") * 60_000_000).alias("t"),
                                (F.col("id") >= 15).cast("int").alias("label"),
                                F.concat(F.lit("host-"), F.col("id") % 6).alias("g"))
    t = splits.temporal(df, "t", "row_id").orderBy("row_id").collect()
    assert [r.split for r in t] == ["train"] * 18 + ["calibration"] * 6 + ["test"] * 6
    g = splits.by_group(df, "g").groupBy("g").agg(F.countDistinct("split").alias("n")).collect()
    assert len(g) == 6 and all(r.n == 1 for r in g)
    s = {(r.label, r.split): r["count"] for r in splits.stratified(df, "label", "row_id").groupBy("label", "split").count().collect()}
    assert s == {(k, p): n for k in (0, 1) for p, n in (("train", 9), ("calibration", 3), ("test", 3))}


def test_calibration_steps(spark):
    y, s = _labelled(100)
    df = _scored(spark, y, s).withColumnRenamed("score", "raw")
    w, b = 1.0, 0.0
    for _ in range(5):
        p = 1 / (1 + np.exp(-(w * s + b)))
        w, b = w - np.mean((p - y) * s) * 0.1, b - np.mean(p - y) * 0.1
    assert models.calibrate_steps(df, steps=5) == pytest.approx((w, b), abs=1e-7)


def test_calibration_steps_beyond_the_driver(spark):
    """More scores than the driver holds, one of them a third of all rows: every row counts."""
    y, s = np.append(np.arange(200) % 2, np.ones(100, int)), np.append(np.linspace(0, 1, 200), np.full(100, 0.77))
    df = _scored(spark, y, s).withColumnRenamed("score", "raw")
    w, b = 1.0, 0.0
    for _ in range(5):
        p = 1 / (1 + np.exp(-(w * s + b)))
        w, b = w - np.mean((p - y) * s) * 0.1, b - np.mean(p - y) * 0.1
    assert models.calibrate_steps(df, steps=5, max_scores=50) == pytest.approx((w, b), abs=1e-7)


def test_isolation_forest_ranks_outliers(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(300, 3)), rng.normal(8, 1, size=(10, 3))])
    df = spark.createDataFrame([(i, int(i >= 300), *map(float, r)) for i, r in enumerate(x)],
                               "row_id long, label int, a double, b double, c double")
    m = models.fit_isolation(df.filter("label = 0"), ["a", "b", "c"], "row_id", trees=30)
    out = df.withColumn("score", models.isolation_score(m))
    r = out.groupBy("label").agg(F.avg("score").alias("m"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    by = {x.label: x for x in r}
    assert by[1].m > 0.7 > by[0].m and 0 <= by[0].lo and by[1].hi <= 1
    share = out.filter("label = 0").agg(F.avg((F.col("score") > 0.5).cast("double"))).first()[0]
    assert share == pytest.approx(0.10, abs=0.02)
    again = models.fit_isolation(df.filter("label = 0").repartition(7), ["a", "b", "c"], "row_id", trees=30)
    assert again["offset"] == pytest.approx(m["offset"])


def test_branch_reports(spark):
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") / 10).alias("feature_a"),
                                (F.col("id") % 5 / 5).alias("feature_b"), (F.col("id") % 2).cast("int").alias("label"))
    rows = splits.stratified(df, "label", "row_id")
    r = training.train_all(rows, ["feature_a", "feature_b"], ("fft", "kitsune"), calibration_steps=3)
    assert set(r["models"]["fft"]["metrics"]) >= {"roc_auc", "pr_auc", "precision", "recall", "f1", "threshold"}
    with pytest.raises(ValueError):
        training.train_branch("lstm", rows, ["feature_a"])


def test_row_score_matches_numpy(spark):
    x = np.random.default_rng(7).normal(size=(20, 5))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double, e double")
    got = [r.s for r in df.select(scoring.row_robust_score(list("abcde")).alias("s")).collect()]
    expect = []
    for r in x:
        c = np.abs(r - np.median(r))
        expect.append(np.clip(np.mean(c / (np.median(c) + np.std(r) + 1e-9)) / 3, 0, 1))
    assert got == pytest.approx(expect)


def _alerts(spark, n=30):
    docs = [{"alert_id": f"a-{i}", "timestamp": f"2026-09-12T00:00:{i:02d}Z", "src_ip": "10.0.0.1", "risk_score": 0.9,
             "reasons": '["é"]' if i % 2 else ["é"], "tiny": 1e-05, "nothing": None} for i in range(n)]
    return docs, spark.createDataFrame([(i, d["alert_id"], d["timestamp"], json.dumps(d)) for i, d in enumerate(docs)],
                                       "pos long, alert_id string, timestamp string, doc string")


def test_json_chain_equals_the_serial_digest(spark):
    docs, df = _alerts(spark)
    c = integrity.append_chain(df, "pos", integrity.sorted_json_payload(F.col("doc")), F.col("timestamp"))
    prev, expect = "0" * 64, []
    for d in docs:
        d = {**d, "reasons": ["é"]}
        text = json.dumps(d, sort_keys=True, default=str, separators=(",", ":"))
        prev = hashlib.sha256((prev + text + d["timestamp"]).encode()).hexdigest()
        expect.append(prev)
    rows = c.orderBy("chain_sequence").collect()
    assert [r.evidence_hash for r in rows] == expect
    payload = integrity.sorted_json_payload(F.col("doc"))
    ok = integrity.verify_chain(c, payload, F.col("timestamp"), chunk=7).first()
    assert ok.valid and ok["count"] == 30 and ok.head_hash == expect[-1] and ok.reason == "verified"


def test_tampering_is_located(spark):
    _, df = _alerts(spark)
    payload, ts = integrity.sorted_json_payload(F.col("doc")), F.col("timestamp")
    c = integrity.append_chain(df, "pos", payload, ts)
    edited = c.withColumn("doc", F.when(F.col("pos") == 12, F.replace("doc", F.lit("0.9"), F.lit("0.1"))).otherwise(F.col("doc")))
    r = integrity.verify_chain(edited, payload, ts, chunk=5).first()
    assert (r.valid, r.broken_index, r.broken_sequence, r.broken_alert_id) == (False, 12, 13, "a-12")
    assert r.reason.startswith("Tampered alert payload")
    unlinked = c.withColumn("previous_hash", F.when(F.col("pos") == 20, F.lit("f" * 64)).otherwise(F.col("previous_hash")))
    r = integrity.verify_chain(unlinked, payload, ts, chunk=5).first()
    assert r.broken_sequence == 21 and r.reason.startswith("Hash chain broken")
    beheaded = integrity.verify_chain(c.filter("pos > 3"), payload, ts).first()
    assert beheaded.broken_index == 0
    assert integrity.verify_chain(c.limit(0), payload, ts).first().reason == "empty_chain"


def test_long_chains_verify_and_continue(spark):
    rows = spark.range(15_000).select(F.col("id").alias("pos"), F.concat(F.lit("a-"), F.col("id")).alias("alert_id"),
                                      F.lit("t").alias("timestamp"), (F.col("id") % 3).alias("day"))
    payload, ts = F.col("alert_id"), F.col("timestamp")
    whole = integrity.append_chain(rows.repartition(7), "pos", payload, ts)
    ok = integrity.verify_chain(whole, payload, ts, chunk=1000).first()
    assert ok.valid and ok["count"] == 15_000 and ok.head_sequence == 15_000
    first = integrity.append_chain(rows.filter("pos < 7000"), "pos", payload, ts)
    rest = integrity.append_chain(rows.filter("pos >= 7000"), "pos", payload, ts, heads=integrity.chain_heads(first))
    assert integrity.chain_heads(rest).first().head_hash == ok.head_hash
    days = integrity.append_chain(rows, "pos", payload, ts, ("day",))
    heads = integrity.chain_heads(days, ("day",))
    cut = days.filter("NOT (day = 0 AND pos = 600) AND NOT (day = 1 AND pos > 14000)")
    got = {r.day: r for r in integrity.verify_chain(cut, payload, ts, keys=("day",), heads=heads).collect()}
    assert [got[d].valid for d in (0, 1, 2)] == [False, False, True] and got[0].broken_sequence == 202
    assert got[1].reason.startswith("Chain ends before its head")
    chained = integrity.head_chain(heads, ("day",))
    sums = F.concat_ws("|", *[F.col(c).cast("string") for c in ("day", "rows", "head_sequence", "head_hash")])
    assert integrity.verify_chain(chained.withColumn("alert_id", F.col("day").cast("string")), sums, F.lit("")).first().valid


def test_retention_by_cutoff_equals_the_merged_top(spark, monkeypatch):
    from tapline.operators import reporting

    df = spark.range(3000).select((F.col("id") * 7919 % 100_000 * 1_000_000).alias("ts_us"), F.col("id").cast("string").alias("alert_id"))
    want = sorted(tuple(r) for r in reporting.keep_newest(df, 1234).collect())
    monkeypatch.setattr(reporting, "PER_TASK", 10)
    assert sorted(tuple(r) for r in reporting.keep_newest(df, 1234).select("ts_us", "alert_id").collect()) == want


def test_newton_reaches_the_optimum(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2.5 * x - 1)))).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "raw double, label int")
    passes, real = [0], models.materialise
    w, b = models.calibrate_newton(rows)
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs(((p - y) * x).sum()) < 1e-6 and abs((p - y).sum()) < 1e-6
    ml = models.calibrate_optimum(rows)
    assert abs(w - ml[0]) < 1e-3 and abs(b - ml[1]) < 1e-3

    class Counted:
        def __init__(self, df):
            self.df = df

        def agg(self, *cols):
            passes[0] += 1
            return self.df.agg(*cols)

    models.materialise = lambda df, name: Counted(real(df, name))
    try:
        models.calibrate_newton(rows)
    finally:
        models.materialise = real
    assert passes[0] <= 10
    assert models.calibrate_newton(rows.limit(0)) == (1.0, 0.0)
    one = spark.createDataFrame([(2.0, i % 4 == 0) for i in range(40)], "raw double, label boolean").withColumn("label", F.col("label").cast("int"))
    w, b = models.calibrate_newton(one)
    assert abs(1 / (1 + np.exp(-(w * 2 + b))) - 0.25) < 1e-6


def test_greedy_choices_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    rows = sorted({(f"k{rng.integers(0, 5)}", int(t)) for t in rng.integers(0, 4000, 1500)})
    df = spark.createDataFrame([(k if k != "k0" else None, t) for k, t in rows], "key string, at long").repartition(5)
    for step in (1, 7, 100, 5000):
        want, last = [], {}
        for k, t in rows:
            if k not in last or t - last[k] >= step:
                last[k] = t
                want.append((k if k != "k0" else None, t))
        got = [tuple(r) for r in greedy.spaced(df, ["key"], "at", step).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert greedy.spaced(df.limit(0), ["key"], "at", 3).collect() == []


def test_long_chains_in_bounded_memory(spark):
    """A stretch of a million runs, and a session of a million intervals: one key, one hit every other window."""
    n = 1_000_000
    hits = spark.range(n).select(F.lit("k").alias("src_ip"), (F.col("id") * 2_000_000).alias("window_end"))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")  # what a task holds at a time
    try:
        out = persistence.cooldown(hits, cfg=Config(cooldown_us=5_000_000))
        assert [tuple(r) for r in out.agg(F.count("*"), F.max("window_end"), F.sum(F.col("window_end") % 6_000_000)).collect()] == [
            (333_334, 1_999_998_000_000, 0)]
        panes = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("_pane"))
        assert greedy.spaced(panes, ["k"], "_pane", 61).count() == -(-n // 61)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
