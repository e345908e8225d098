"""Tables behind the dashboard: filters, rankings, counts and retention over alert rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.operators import ordered
from tapline.schema import RISK_LEVELS
from tapline.session import materialise

PER_TASK = 10_000  # rows a task may keep for a merged top-n


def filter_alerts(df: DataFrame, severity: str | None = None, category: str | None = None,
                  source: str | None = None, destination: str | None = None, start_us: int | None = None,
                  end_us: int | None = None) -> DataFrame:
    """Equality filters and an inclusive time range, all of which reach the scan."""
    for col, value in (("risk_level", severity), ("attack_category", category), ("src_ip", source),
                       ("dst_ip", destination)):
        if value:
            df = df.filter(F.col(col) == value)
    if start_us is not None:
        df = df.filter(F.col("ts_us") >= start_us)
    if end_us is not None:
        df = df.filter(F.col("ts_us") <= end_us)
    return df


def alert_by_id(df: DataFrame, alert_id: str | Column) -> DataFrame:
    return df.filter(F.col("alert_id") == alert_id)


def newest(df: DataFrame, limit: int = 100, order: str = "ts_us", tie: str = "alert_id", most: int = 1000) -> DataFrame:
    """The newest rows; the limit is clamped to 1..most and taken per task before the merge."""
    return df.orderBy(F.desc(order), tie).limit(max(1, min(limit, most)))


def evidence_chain(df: DataFrame, limit: int = 100) -> DataFrame:
    rows = df.filter("evidence_hash IS NOT NULL").select(
        "chain_sequence", "alert_id", "ts_us", "risk_level", "attack_category", "previous_hash", "evidence_hash")
    return rows.orderBy(F.desc("chain_sequence")).limit(max(1, min(limit, 1000)))


def evidence_chains(df: DataFrame, keys: list[str], limit: int = 100) -> DataFrame:
    """The newest links of every chain, newest first; a task keeps ``limit`` links a chain before they meet."""
    w = Window.partitionBy(*keys).orderBy(F.desc("chain_sequence"))
    return (df.filter("evidence_hash IS NOT NULL").withColumn("newest", F.row_number().over(w))
            .filter(F.col("newest") <= max(1, min(limit, 1000))))


def keep_newest(df: DataFrame, n: int, order: str = "ts_us", tie: str = "alert_id") -> DataFrame:
    """Retention: the newest n rows.

    Up to ``PER_TASK`` rows every task keeps its own newest n before the merge. Beyond, the input is stored once, the
    cut-off is found from counts per minute, and only the minute that straddles it is ordered.
    """
    if n <= PER_TASK:
        return df.orderBy(F.desc(order), tie).limit(n)
    work = materialise(df, "retention").withColumn("_min", -F.floor(F.col(order) / 60_000_000))
    counts = work.groupBy("_min").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_min").rowsBetween(Window.unboundedPreceding, 0)
    edges = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_before", F.col("_upto") - F.col("_n"))
    kept = work.join(edges.filter(F.col("_before") < n), "_min")
    sure = kept.filter(F.col("_upto") <= n)
    edge = kept.filter(F.col("_upto") > n)
    by = Window.partitionBy("_min").orderBy(F.desc(order), tie)
    edge = edge.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") + F.col("_before") <= n)
    return sure.drop("_min", "_n", "_upto", "_before").unionByName(edge.drop("_min", "_n", "_upto", "_before", "_r"))


def retention(flows: DataFrame, alerts: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    return (keep_newest(flows, cfg.keep_flows, "last_us", "flow_id"), keep_newest(alerts, cfg.keep_alerts))


def named(col: str) -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("UNKNOWN"))


def hour_bucket(ts: str = "ts_us") -> Column:
    return F.date_format(F.timestamp_micros(F.col(ts)), "yyyy-MM-dd'T'HH")


def dashboard(df: DataFrame, top: int = 10, newest_only: int | None = None) -> DataFrame:
    """Counts by level, category, source, destination and hour in one pass with grouping sets.

    Returns ``(section, name, count)``; sources and destinations keep their top entries.
    ``newest_only`` restricts to the newest rows first, as the bounded dashboard view does.
    """
    if newest_only:
        df = keep_newest(df, newest_only)
    rows = df.select(named("risk_level").alias("level"), named("attack_category").alias("category"),
                     named("src_ip").alias("source"), named("dst_ip").alias("destination"),
                     hour_bucket().alias("hour"))
    dims = ["level", "category", "source", "destination", "hour"]
    sets = [[F.col(d)] for d in dims] + [[]]
    counted = rows.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("g"))
    # grouping_id has a zero bit for the one column a set groups by.
    full = (1 << len(dims)) - 1
    section, name = F.when(F.col("g") == full, F.lit("total")), F.lit("alerts")
    for i, d in enumerate(dims):
        bit = full ^ (1 << (len(dims) - 1 - i))
        section = section.when(F.col("g") == bit, F.lit(d))
        name = F.when(F.col("g") == bit, F.col(d)).otherwise(name)
    counted = materialise(counted.select(section.alias("section"), name.alias("name"), "count"), "dashboard")
    w = Window.partitionBy("section").orderBy(F.desc("count"), "name")
    ranked = counted.filter(F.col("section").isin("source", "destination"))
    ranked = ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")
    return counted.filter(~F.col("section").isin("source", "destination")).unionByName(ranked)


def kpis(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    """Totals: alerts, packets, bytes and flow summaries in one row."""
    a = alerts.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"),
                   F.count_if(F.col("risk_level") == "HIGH").alias("high")).withColumn("_k", F.lit(1))
    f = flows.agg(F.count(F.lit(1)).alias("flows"), F.coalesce(F.sum("packets"), F.lit(0)).alias("packets"),
                  F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("_k", F.lit(1))
    return a.join(f, "_k").drop("_k")


def level_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(named("risk_level").alias("risk_level")).agg(F.count(F.lit(1)).alias("count"))


def top_categories(alerts: DataFrame, k: int = 10) -> DataFrame:
    return (alerts.groupBy(named("attack_category").alias("category")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "category").limit(k))


def heatmap(alerts: DataFrame) -> DataFrame:
    ts = F.timestamp_micros(F.col("ts_us"))
    return alerts.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "HH").alias("hour"),
                          "attack_category").agg(F.count(F.lit(1)).alias("count"))


def report(alerts: DataFrame, start_us: int | None = None, end_us: int | None = None,
           category: str | None = None) -> DataFrame:
    """Counts per category and per level, every level of the domain included."""
    rows = filter_alerts(alerts, category=category, start_us=start_us, end_us=end_us)
    counted = rows.groupBy(named("attack_category").alias("cat"), "risk_level").agg(F.count(F.lit(1)).alias("n"))
    cats = counted.groupBy(F.lit("category").alias("section"), F.col("cat").alias("name")).agg(F.sum("n").alias("count"))
    domain = alerts.sparkSession.createDataFrame([(x,) for x in RISK_LEVELS], "name string")
    by_level = counted.groupBy(F.col("risk_level").alias("name")).agg(F.sum("n").alias("count"))
    levels = by_level.join(F.broadcast(domain), "name", "right").select(
        F.lit("level").alias("section"), "name", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")).select(
        F.lit("total").alias("section"), F.lit("alerts").alias("name"), "count")
    return cats.unionByName(levels).unionByName(total)


def score_profile(scored: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Mean, deviation, minimum and maximum of each model's score per scenario, to four places."""
    long = scored.select(scenario, F.explode(F.map_concat(
        "model_scores", F.create_map(F.lit("fused"), F.col("fusion.score")))).alias("model", "s"))
    return long.groupBy(scenario, "model").agg(
        F.round(F.avg("s"), 4).alias("mean"), F.round(F.stddev_pop("s"), 4).alias("std"),
        F.round(F.min("s"), 4).alias("min"), F.round(F.max("s"), 4).alias("max"), F.count("s").alias("samples"))


def capture_rate(traffic: DataFrame, interval_us: int = 1_000_000) -> DataFrame:
    """Packets and bits per interval."""
    start = (F.col("ts_us") - F.pmod("ts_us", F.lit(interval_us))).alias("interval_us")
    per_s = interval_us / 1e6
    return traffic.groupBy(start).agg(
        F.round(F.count(F.lit(1)) / per_s, 2).alias("current_pps"),
        F.round(F.sum("packet_len") * 8 / per_s, 2).alias("current_bps"))


def verdict_view(alerts: DataFrame, verified: Column | None = None) -> DataFrame:
    """The nested validation view of an alert: verdict, reasons, evidence, models, integrity."""
    have = set(alerts.columns)
    opt = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return alerts.select(
        "alert_id",
        F.struct(F.col("attack_category").alias("category"), "risk_level", "risk_score", "confidence").alias("verdict"),
        opt("reasons").alias("why"),
        F.struct(opt("top_features").alias("top_features"), opt("protocol_evidence").alias("protocol"),
                 F.col("src_ip").alias("source"), F.col("dst_ip").alias("destination"),
                 opt("feature_values").alias("feature_values")).alias("evidence"),
        opt("model_scores").alias("models"),
        F.struct(opt("evidence_hash").alias("evidence_hash"), opt("previous_hash").alias("previous_hash"),
                 opt("chain_sequence").alias("chain_sequence"),
                 (verified if verified is not None else F.lit(None).cast("boolean")).alias("verified"))
        .alias("integrity"))


def exact_quantiles(df: DataFrame, col: str, qs: list[float], bins: int = 4096) -> DataFrame:
    """Interpolated quantiles of a column, one row ``(q, value)`` each.

    Values are ranked through equal-width bins of their range, each cut into as many again so that
    outliers do not crowd the rest into one task; only ranks next to a quantile are kept.
    """
    x = df.select(F.col(col).cast("double").alias("x")).filter("x IS NOT NULL")
    lo, hi = x.agg(F.min("x")).scalar(), x.agg(F.max("x")).scalar()
    x = x.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    width = F.greatest((hi - lo) / bins, F.lit(1e-300))
    x = x.withColumns({"_bin": F.floor((F.col("x") - lo) / width),
                       "_sub": F.floor((F.col("x") - lo) / width * bins)})
    r = ordered.running_totals(x, ["_bin", "_sub"], ["x"], {"upto": F.col("c")})
    n = x.agg(F.sum("c")).scalar()
    wanted = F.explode(F.array(*[F.lit(q) for q in qs]))
    r = r.withColumn("q", wanted).withColumn("_pos", F.col("q") * (n - 1))
    lower, upper = F.floor("_pos") + 1, F.ceil("_pos") + 1
    covers = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("c") < k)
    near = r.filter(covers(lower) | covers(upper))
    out = near.groupBy("q", "_pos").agg(
        F.min(F.when(covers(lower), F.col("x"))).alias("a"), F.min(F.when(covers(upper), F.col("x"))).alias("b"))
    return out.select("q", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("_pos") - F.floor("_pos"))).alias("value"))
