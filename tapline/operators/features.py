"""The window feature row: 61 columns per window, from slots, value counts and spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.functions.math import floor_div, merge_moments, pin
from tapline.functions.protocol import modbus
from tapline.operators import bigfft, windows
from tapline.operators.spectral import SPECTRAL, spectral_of_times
from tapline.session import tasks_for

# Addresses with a presence column in the model schema.
MODEL_SRC_IPS = ["192.168.1.2", "192.168.1.3"]
MODEL_DST_IPS = ["192.168.1.5", "192.168.1.6"]

# Columns the baseline deviation averages over.
BASELINE_FEATURES = [
    "packets", "bytes", "packets_per_sec", "bytes_per_sec", "flow_count", "port_diversity",
    "destination_diversity", "source_diversity", "fan_out", "fan_in", "new_ip_ratio", "subnet_diversity",
    "packet_len_mean", "packet_len_std", "ttl_mean", "ttl_delta", "ip_id_entropy", "ip_flags_entropy",
    "tcp_flags_entropy", "dscp_entropy", "iat_mean", "iat_variance", "iat_std", "iat_skewness",
    "iat_kurtosis", "iat_cv",
]

FEATURES = BASELINE_FEATURES + [
    "baseline_deviation", "dominant_frequency", "spectral_flatness", "harmonic_ratio", "spectral_centroid",
    "periodicity_score", "authorized_peer_status", "lateral_movement_score", "protocol", "udp_ratio",
    "udp_burst_score", "ttl_anomaly_score", "payload_integrity_anomaly", "packet_alteration_score",
    "ip_spoofing_score", "identity_anomaly_score", "beacon_score", "behavior_anomaly_score", "packet_size",
    "inter_arrival_time", "packet_count_5s", "mean_packet_size", "spectral_entropy", "frequency_band_energy",
    "protocol_type_TCP", "protocol_type_UDP", "src_port", "dst_port",
    *[f"src_ip_{ip}" for ip in MODEL_SRC_IPS], *[f"dst_ip_{ip}" for ip in MODEL_DST_IPS],
    "tcp_flags_FIN", "tcp_flags_SYN", "tcp_flags_SYN-ACK",
]
NUMERIC_FEATURES = [f for f in FEATURES if f != "protocol"]


def q(name: str) -> str:
    return f"`{name}`"


def merged_iats(cfg: Config) -> Column:
    """Moments of all arrival gaps of a window: gaps inside slots plus those between slots."""
    s = F.col("_slots")

    def between(i: Column) -> Column:
        a, b = F.element_at(s, i - 1)["last_us"], F.element_at(s, i)["first_us"]
        gap = (b / 1e6 - a / 1e6) if cfg.iat_mode == "double" else (b - a).cast("double")
        zero = F.lit(0.0)
        return F.struct(F.lit(1.0).alias("n"), gap.alias("mean"), zero.alias("m2"), zero.alias("m3"), zero.alias("m4"))

    none = F.filter(F.transform(s, lambda x: x["iat_m"]), lambda m: F.lit(False))
    bridges = F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(2), F.size(s)), between)).otherwise(none)
    return merge_moments(F.concat(F.transform(s, lambda x: x["iat_m"]), bridges))


def combine_slots(slots: DataFrame, cfg: Config, group_cols: tuple[str, ...] = (), whole: bool = False,
                  times: bool = False, tasks: int | None = None) -> DataFrame:
    """Slot rows to window rows. A sliding window gathers at most window/slot slot rows; ``tasks`` share the slots."""
    parts = ["slot", "first_us", "last_us", "len_m", "iat_m"] + (["times"] if times else [])
    chunk = ["_chunk"] if tasks and not whole else []
    if chunk:
        rows = windows.dealt(slots, windows.pane_of_slot(F.col("slot"), cfg), cfg, [*group_cols], tasks)
    else:
        rows = windows.explode_slots(slots, cfg, whole)
    either = lambda c: F.max(c).alias(c)
    out = rows.groupBy(*group_cols, *chunk, "window_end").agg(
        *[F.sum(c).alias(c) for c in ("n", "bytes", "ttl_n", "ttl_sum", "tcp_n", "udp_n", "icmp_n", "syn_n",
                                      "rst_n", "altered_n", "spoofed_n")],
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.min("ttl_min").alias("ttl_min"), F.max("ttl_max").alias("ttl_max"),
        either("has_ot"), either("has_command"),
        *[F.min(c).alias(c) for c in ("head", "head_sport", "head_dport", "head_modbus")],
        F.max("tail").alias("tail"),
        F.array_sort(F.collect_list(F.struct(*parts))).alias("_slots"))
    out = out.withColumns({
        "len_m": merge_moments(F.transform("_slots", lambda x: x["len_m"])),
        "iat_m": merged_iats(cfg),
    })
    if times:
        whole_array = ~F.exists("_slots", lambda x: x["times"].isNull())
        out = out.withColumn("times", F.when(whole_array, F.flatten(F.transform("_slots", lambda x: x["times"]))))
    return out.drop("_slots", *chunk)


def iat_columns(cfg: Config) -> dict[str, Column]:
    m = F.col("iat_m")
    unit = 1.0 if cfg.iat_mode == "double" else 1e6
    n, var = m["n"], m["m2"] / m["n"]
    some, spread = n > 0, (n > 0) & (m["m2"] > 0)
    zero = F.lit(0.0)
    mean = F.when(some, m["mean"] / unit).otherwise(zero)
    std = F.when(spread, F.sqrt(var) / unit).otherwise(zero)
    return {
        "iat_mean": mean, "iat_variance": F.when(spread, var / (unit * unit)).otherwise(zero), "iat_std": std,
        "iat_skewness": F.when(spread & (n >= 3), m["m3"] / n / F.pow(var, F.lit(1.5))).otherwise(zero),
        "iat_kurtosis": F.when(spread & (n >= 4), m["m4"] / n / (var * var) - 3.0).otherwise(zero),
        "iat_cv": std / (mean + 1e-9),
    }


#: Fields whose values are only counted; the dominant protocol compares texts, which would make Spark sort all counts.
COUNTED = [f for f in windows.FIELDS if f != "proto"]


def value_features(counts: DataFrame, protocols: DataFrame, group_cols: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """Distinct counts, entropies, dominant protocol and presence flags per window, from the counts of the fields
    ``COUNTED`` and from those of the protocols. Every window has a `flow`, so none is in ``protocols`` alone."""
    keys = [*group_cols, "window_end"]
    dominant = (protocols.repartition(tasks, *keys) if tasks else protocols).groupBy(*keys).agg(
        F.max_by("value", F.struct("n", (-F.col("seen")).alias("early"))).alias("protocol"))
    return value_sums(counts, group_cols, tasks).join(dominant, keys, "left")


#: Fields with an entropy.
ENTROPIES = ["ip_id", "ip_flags", "tcp_flags", "dscp", "dport"]


def value_sums(counts: DataFrame, group_cols: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """Distinct counts, entropies and presence flags per window: numbers alone, summed by hash.

    With ``tasks`` the counts of a window, which lie in parts, are summed where they are before the windows are dealt out.
    """
    is_ = lambda f: F.col("field") == f
    token = lambda t: F.max(F.when(is_("tcp_flags"), F.array_contains(F.split(F.upper("value"), ","), t)))
    present = lambda f, ip: F.max((is_(f) & (F.col("value") == ip)).cast("double"))
    distinct = {"flow_count": "flow", "port_diversity": "dport", "destination_diversity": "dst", "source_diversity": "src",
                "subnet_diversity": "subnet", "ttl_distinct": "ttl"}
    seen = {**{f"src_ip_{ip}": present("src", ip) for ip in MODEL_SRC_IPS}, **{f"dst_ip_{ip}": present("dst", ip) for ip in MODEL_DST_IPS}}
    tokens = {"_fin": token("FIN"), "_syn": token("SYN"), "_ack": token("ACK"), "_synack": token("SYN-ACK")}
    keys = [*group_cols, "window_end"]
    places = [c for c in windows.PLACES if c in counts.columns]
    parts = counts.groupBy(*keys, *places).agg(
        *[F.count_if(is_(f)).alias(name) for name, f in distinct.items()],
        *[x.alias(f"_{f}_{name}") for f in ENTROPIES for name, x in windows.entropy_sums(F.col("n"), is_(f)).items()],
        *[c.alias(name) for name, c in {**seen, **tokens}.items()])
    if tasks:
        parts = parts.repartition(tasks, *keys)
    out = parts.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in distinct],
        *[F.sum(f"_{f}_{name}").alias(f"_{f}_{name}") for f in ENTROPIES for name in ("total", "logs")],
        *[F.max(q(name)).alias(name) for name in (*seen, *tokens)]) if places else parts
    return out.select(
        *keys, *[F.col(name).cast("double").alias(name) for name in distinct],
        *[windows.entropy_of(F.col(f"_{f}_total"), F.col(f"_{f}_logs")).alias("port_entropy" if f == "dport" else f"{f}_entropy")
          for f in ENTROPIES],
        *[F.coalesce(q(name), F.lit(0.0)).alias(name) for name in seen],
        *[F.coalesce(name, F.lit(False)).alias(name) for name in tokens])


def window_features(df: DataFrame, cfg: Config = DEFAULT, group_cols: tuple[str, ...] = (), whole: bool = False,
                    baseline: dict[str, float] | None = None, emit_partial: bool = False,
                    spectral: bool = True) -> DataFrame:
    """One row per window: the feature contract plus the window's identity columns.

    ``df`` is traffic with the `altered` and `spoofed` booleans (absent means false).
    """
    n = tasks_for(df)
    w = combine_slots(windows.slots(df, cfg, group_cols, times=spectral, tasks=n), cfg, group_cols, whole, times=spectral, tasks=n)
    v = value_features(windows.value_counts(df, cfg, group_cols, COUNTED, whole, n, parts=True),
                       windows.value_counts(df, cfg, group_cols, ["proto"], whole, n), group_cols, n)
    f = w.repartition(n, *group_cols, "window_end").join(v, [*group_cols, "window_end"])
    if not whole:
        f = windows.complete_only(f, df, emit_partial)
    return feature_columns(f, df, cfg, group_cols, whole, baseline, spectral)


def feature_columns(f: DataFrame, df: DataFrame, cfg: Config = DEFAULT, group_cols: tuple[str, ...] = (), whole: bool = False,
                    baseline: dict[str, float] | None = None, spectral: bool = True) -> DataFrame:
    """The feature contract over joined rows of `combine_slots` and `value_features`.

    ``df`` has the times of the windows' events; only windows beyond the array bound read them.
    """
    baseline = baseline or {}
    keys = [*group_cols, "window_end"]
    n = F.col("n").cast("double")
    duration = F.greatest((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(1.0))
    some_ttl = F.col("ttl_n") > 0
    lm = F.col("len_m")
    f = f.withColumns({
        "packets": n, "packets_per_sec": n / duration, "bytes_per_sec": F.col("bytes") / duration,
        "fan_out": F.col("destination_diversity"), "fan_in": F.col("source_diversity"),
        "new_ip_ratio": F.col("destination_diversity") / n,
        "packet_len_mean": lm["mean"], "packet_len_std": F.sqrt(lm["m2"] / lm["n"]),
        "ttl_mean": F.when(some_ttl, F.col("ttl_sum") / F.col("ttl_n")).otherwise(F.lit(0.0)),
        "ttl_delta": F.when(some_ttl, (F.col("ttl_max") - F.col("ttl_min")).cast("double")).otherwise(F.lit(0.0)),
        "udp_ratio": F.col("udp_n") / n,
        "payload_integrity_anomaly": F.col("altered_n") / n, "ip_spoofing_score": F.col("spoofed_n") / n,
        "ttl_anomaly_score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ttl_distinct") - 1) / 4.0),
        **iat_columns(cfg),
    }).withColumn("bytes", F.col("bytes").cast("double"))
    if baseline:
        terms = [F.abs(F.col(c) - F.lit(float(baseline[c]))) / F.lit(abs(float(baseline[c])) + 1)
                 for c in BASELINE_FEATURES if c in baseline]
        total = sum(terms, F.lit(0.0))
        f = f.withColumn("baseline_deviation", total / F.lit(float(len(BASELINE_FEATURES))))
    else:
        f = f.withColumn("baseline_deviation", F.lit(0.0))
    if spectral:
        f = f.withColumn("_sp", spectral_of_times(F.col("times"), cfg.iat_mode)).drop("times")
        f = bigfft.fill(f, df, cfg, group_cols, whole)
        f = f.select("*", *[F.col(f"_sp.{c}").alias(c) for c in SPECTRAL]).drop("_sp")
    else:
        f = f.withColumns({c: F.lit(0.0) for c in SPECTRAL})
    regular = F.when((F.col("packets") >= 4) & (F.col("iat_mean") > 0), F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), 1.0 - F.col("iat_cv") / 0.20))).otherwise(F.lit(0.0))
    f = f.withColumns({
        "_reg": regular,
        "udp_burst_score": F.least(F.lit(1.0), F.col("udp_ratio") * F.greatest(
            F.col("packets_per_sec") / 100.0, F.col("bytes_per_sec") / 100000.0)),
        "lateral_movement_score": F.least(F.lit(1.0), F.col("fan_out") / 10.0),
        "authorized_peer_status": F.lit(1.0 if baseline.get("authorized_peer_status", 1.0) else 0.0),
    })
    f = f.withColumn("periodicity_score", F.greatest("periodicity_score", F.col("_reg") * 4.0))
    f = f.withColumn("beacon_score", F.when(F.col("has_ot") & ~F.col("has_command"), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), 0.6 * F.col("_reg") + 0.4 * F.when(F.col("has_command"), F.lit(1.0)).otherwise(F.lit(0.5)))))
    cap = lambda c, s: F.least(F.lit(1.0), F.abs(F.col(c)) / s)
    f = f.withColumn("behavior_anomaly_score", F.least(
        F.lit(1.0),
        0.25 * cap("baseline_deviation", 2.0) + 0.35 * cap("fan_out", 10.0) + 0.15 * cap("port_diversity", 10.0)
        + 0.15 * F.col("udp_burst_score") + 0.10 * cap("periodicity_score", 10.0) + 0.15 * F.col("beacon_score")))
    one = lambda cond: F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))
    f = f.withColumns({
        "packet_alteration_score": F.col("payload_integrity_anomaly"),
        "identity_anomaly_score": F.col("ip_spoofing_score"),
        "packet_size": F.col("packet_len_mean"), "inter_arrival_time": F.col("iat_mean"),
        "packet_count_5s": F.col("packets"), "mean_packet_size": F.col("packet_len_mean"),
        "spectral_entropy": F.col("spectral_flatness"), "frequency_band_energy": F.col("harmonic_ratio"),
        "protocol_type_TCP": one(F.col("protocol") == "TCP"), "protocol_type_UDP": one(F.col("protocol") == "UDP"),
        "src_port": F.coalesce(F.col("head_sport.v").cast("double"), F.lit(0.0)),
        "dst_port": F.coalesce(F.col("head_dport.v").cast("double"), F.lit(0.0)),
        "tcp_flags_FIN": one(F.col("_fin")), "tcp_flags_SYN": one(F.col("_syn") & ~F.col("_ack")),
        "tcp_flags_SYN-ACK": one((F.col("_syn") & F.col("_ack")) | F.col("_synack")),
    })
    return f.select(
        *keys, "first_us", "last_us", F.col("head.src_ip").alias("src_ip"), F.col("head.dst_ip").alias("dst_ip"),
        F.col("head.src_port").alias("first_src_port"), F.col("head.dst_port").alias("first_dst_port"),
        *([] if "asset_id" in keys else [F.col("head.asset_id").alias("asset_id")]), F.col("tail.data_source").alias("data_source"),
        F.col("head_modbus.v").alias("modbus_hex"), *[q(c) for c in FEATURES])


def with_protocol(f: DataFrame, quantity_check: str = "all") -> DataFrame:
    """Decode the window's first Modbus payload; windows without one get a null struct."""
    decoded = modbus(F.col("modbus_hex"), quantity_check)
    out = pin(f, {"protocol_evidence": F.when(F.col("modbus_hex").isNotNull(), decoded)})
    return out.withColumn("protocol_anomaly_score",
                          F.coalesce(F.col("protocol_evidence.protocol_anomaly_score"), F.lit(0.0)))


#: Windows of a calendar chunk of silence; the longest array a silence makes has about as many entries.
SILENT_CHUNK = 3600


def _on_grid(t: Column, start: Column, step: int) -> Column:
    """The first point from ``t`` on that is a whole number of steps from ``start``."""
    return t + F.pmod(start - t, F.lit(step))


def with_empty_windows(f: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add a zero row for every silent window between the first and the last (ungrouped windows).

    Runs of silence are generated from each window's gap to its predecessor, in time chunks that carry their
    predecessor over, so no global ordering is needed. A silence of any length is cut into calendar chunks
    before its windows are written out.
    """
    from pyspark.sql import Window

    chunk = SILENT_CHUNK * cfg.slide_us
    ends = f.select("window_end", floor_div(F.col("window_end"), chunk).alias("_c"))
    heads = ends.groupBy("_c").agg(F.max("window_end").alias("_last"))
    prior = heads.withColumn("_prior", F.lag("_last").over(Window.orderBy("_c"))).select("_c", "_prior")
    w = Window.partitionBy("_c").orderBy("window_end")
    gaps = (ends.join(prior, "_c")
            .withColumn("_prev", F.coalesce(F.lag("window_end").over(w), F.col("_prior")))
            .filter(F.col("window_end") - F.col("_prev") > cfg.slide_us)
            .select((F.col("_prev") + cfg.slide_us).alias("_a"), (F.col("window_end") - cfg.slide_us).alias("_b")))
    # a long silence is cut at calendar bounds and dealt out, coarse pieces first
    for size in (chunk * SILENT_CHUNK, chunk):
        pieces = gaps.withColumn("_k", F.explode(F.sequence(floor_div(F.col("_a"), size), floor_div(F.col("_b"), size))))
        first, last = F.greatest("_a", _on_grid(F.col("_k") * size, F.col("_a"), cfg.slide_us)), F.least("_b", F.col("_k") * size + (size - 1))
        gaps = pieces.select(first.alias("_a"), last.alias("_b")).filter("_a <= _b").repartition("_a")
    silent = gaps.select(F.explode(F.sequence(F.col("_a"), F.col("_b"), F.lit(cfg.slide_us).cast("bigint"))).alias("window_end"))
    zero = silent.withColumns({c: F.lit(0.0) for c in (
        "packets", "bytes", "packets_per_sec", "bytes_per_sec", "flow_count", "periodicity_score")})
    return (f.withColumn("empty_window", F.lit(0.0))
            .unionByName(zero.withColumn("empty_window", F.lit(1.0)), allowMissingColumns=True))
