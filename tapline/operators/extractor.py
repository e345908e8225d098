"""The second window feature set: 21 columns with rates in bits, TCP flag ratios and bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.operators import windows
from tapline.operators.features import combine_slots, iat_columns
from tapline.operators.spectral import histogram_peak
from tapline.session import tasks_for

COLUMNS = [
    "packets", "bytes", "duration", "pps", "bps", "unique_src_ips", "unique_dst_ips", "unique_dst_ports",
    "tcp_ratio", "udp_ratio", "icmp_ratio", "syn_ratio", "rst_ratio", "mean_len", "std_len", "iat_mean",
    "iat_std", "beacon_jitter_cv", "port_entropy", "dominant_frequency", "burst_ratio",
]
BURST_US = 100_000


def arrival_bins(df: DataFrame, spans: DataFrame, cfg: Config, group_cols: tuple[str, ...] = (),
                 whole: bool = False) -> DataFrame:
    """Arrivals per window in burst bins and in at most 256 histogram bins.

    Bins start at the window's own first event, so each event needs the starts of its windows. They
    are attached per slot (an equi-join on the slot, not on the far hotter window) and the events are
    counted right after, with map-side combine.
    """
    slot_spans = spans
    if whole:
        ev = df.select(*group_cols, "ts_us").withColumn("window_end", F.lit(0).cast("bigint"))
        rows = ev.join(slot_spans, [*group_cols, "window_end"])
    else:
        # Each window lists its slots, so the join key is as fine as a slot.
        per_slide = cfg.slide_us // cfg.slot_us
        last = (F.col("window_end") - cfg.origin_us) / cfg.slide_us
        slots = F.sequence(((last - cfg.window_us // cfg.slide_us) * per_slide + 1).cast("bigint"),
                           (last * per_slide).cast("bigint"))
        per_slot = slot_spans.withColumn("slot", F.explode(slots))
        ev = df.select(*group_cols, "ts_us", windows.slot_of(cfg).alias("slot"))
        # Equal arrival times collapse before the join.
        ev = ev.groupBy(*group_cols, "slot", "ts_us").agg(F.count(F.lit(1)).alias("_c"))
        rows = ev.join(per_slot, [*group_cols, "slot"])
    if whole:
        rows = rows.withColumn("_c", F.lit(1).cast("bigint"))
    if cfg.iat_mode == "double":
        burst = ((F.col("ts_us") / 1e6 - F.col("t0") / 1e6) * 10).cast("bigint")
    else:
        burst = F.expr(f"(ts_us - t0) div {BURST_US}")
    hist = F.when(F.col("span") > 0, F.least(F.col("bins") - 1, F.expr("((ts_us - t0) * bins) div span")))
    rows = rows.select(*group_cols, "window_end", "_c", F.explode(F.array(
        F.struct(F.lit("burst").alias("kind"), burst.alias("bin")),
        F.struct(F.lit("hist").alias("kind"), hist.alias("bin")))).alias("b"))
    return (rows.filter("b.bin IS NOT NULL").groupBy(*group_cols, "window_end", "b.kind", "b.bin")
            .agg(F.sum("_c").alias("c")))


def bin_features(bins: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    burst, hist = F.col("kind") == "burst", F.col("kind") == "hist"
    return bins.groupBy(*group_cols, "window_end").agg(
        F.max(F.when(burst, F.col("c"))).alias("_peak"), F.count_if(burst).alias("_bins"),
        # At most 256 histogram bins exist per window.
        F.map_from_entries(F.collect_list(F.when(hist, F.struct("bin", "c")))).alias("_hist"))


def extract(df: DataFrame, cfg: Config = DEFAULT, group_cols: tuple[str, ...] = (), whole: bool = False,
            emit_partial: bool = False, presented: bool = False) -> DataFrame:
    """One row per window. ``presented`` rounds as the published schema does (2 to 4 places)."""
    keys = [*group_cols, "window_end"]
    tasks = tasks_for(df)
    w = combine_slots(windows.slots(df, cfg, group_cols, tasks=tasks), cfg, group_cols, whole, tasks=tasks)
    counts = windows.value_counts(df, cfg, group_cols, ["src", "dst", "dport"], whole, tasks)
    is_ = lambda f: F.col("field") == f
    v = counts.groupBy(*keys).agg(
        F.count_if(is_("src")).alias("unique_src_ips"), F.count_if(is_("dst")).alias("unique_dst_ips"),
        F.count_if(is_("dport")).alias("unique_dst_ports"),
        windows.entropy_bits(F.col("n"), is_("dport")).alias("port_entropy"))
    span = F.greatest(F.col("last_us") - F.col("first_us"), F.lit(1000))
    spans = w.select(*keys, F.col("first_us").alias("t0"), (F.col("last_us") - F.col("first_us")).alias("span"),
                     F.least(F.lit(256), F.greatest(F.lit(16), F.expr("(last_us - first_us) div 20000")))
                     .cast("bigint").alias("bins"))
    b = bin_features(arrival_bins(df, spans, cfg, group_cols, whole), group_cols)
    f = w.join(v, keys).join(b, keys).join(spans.select(*keys, "bins"), keys)
    if not whole:
        f = windows.complete_only(f, df, emit_partial)
    n = F.col("n").cast("double")
    tcp = F.greatest(F.lit(1), F.col("tcp_n"))
    dense = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1),
                        lambda i: F.coalesce(F.try_element_at(F.col("_hist"), i), F.lit(0).cast("bigint")).cast("double"))
    lm, iat = F.col("len_m"), iat_columns(cfg)
    f = f.withColumns({
        "duration": span / 1e6, "packets": F.col("n"), "pps": n / (span / 1e6),
        "bps": F.col("bytes") * 8 / (span / 1e6),
        **{f"{p}_ratio": F.col(f"{p}_n") / n for p in ("tcp", "udp", "icmp")},
        **{f"{p}_ratio": F.col(f"{p}_n") / tcp for p in ("syn", "rst")},
        "mean_len": lm["mean"], "std_len": F.sqrt(lm["m2"] / lm["n"]),
        "iat_mean": iat["iat_mean"], "iat_std": iat["iat_std"],
        "burst_ratio": F.col("_peak") / F.greatest(F.lit(1.0), n / F.greatest(F.lit(1), F.col("_bins"))),
        "_dense": F.when((F.col("n") >= 8) & (F.col("last_us") > F.col("first_us")), dense),
    })
    f = f.withColumn("beacon_jitter_cv", F.when(F.col("iat_mean") > 0, F.col("iat_std") / F.col("iat_mean"))
                     .otherwise(F.lit(0.0)))
    f = f.withColumn("dominant_frequency", histogram_peak(F.col("_dense"), F.col("duration")))
    if presented:
        places = {2: ["pps", "bps", "mean_len", "std_len"], 3: ["duration", "burst_ratio", "dominant_frequency"],
                  4: ["tcp_ratio", "udp_ratio", "icmp_ratio", "syn_ratio", "rst_ratio", "iat_mean", "iat_std",
                      "beacon_jitter_cv", "port_entropy"]}
        f = f.withColumns({c: F.round(c, k) for k, cols in places.items() for c in cols})
    head = F.col("head")
    return f.select(
        *keys, "first_us", "last_us", *COLUMNS,
        F.when(F.col("unique_src_ips") == 1, head["src_ip"]).otherwise(F.lit("multiple")).alias("src_ip"),
        F.when(F.col("unique_dst_ips") == 1, head["dst_ip"]).otherwise(F.lit("multiple")).alias("dst_ip"),
        F.when(F.col("tcp_n") == F.col("n"), F.lit("TCP")).when(F.col("udp_n") == F.col("n"), F.lit("UDP"))
        .when(F.col("icmp_n") == F.col("n"), F.lit("ICMP")).otherwise(F.lit("MIXED")).alias("protocol"))
