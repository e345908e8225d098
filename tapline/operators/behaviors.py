"""Behaviour rules over trailing event time: port scan, host sweep, beacon, reset storm.

Rows are judged in arrival order ``(ts_us, event_id)``: a row sees itself and earlier rows.

Rows are handed over in one of two ways, with equal results. By default one shuffle on (source, time chunk) serves all four rules. Distinct counts over a trailing range
are not recomputed per row; a value contributes +1 where it enters the range and -1 where its last
occurrence leaves it, so a running sum gives the exact distinct count in linear time. Each chunk
carries the rows of the preceding horizon, which makes chunks independent: a source that sends a
third of all rows is spread over as many tasks as it has chunks.

With ``behaviour_slot_us`` the counts work on two levels, for sources too dense for a chunk: traffic is first reduced,
with map-side combine, to the first and last occurrence of every (source, host, port) per slot. A slot is no longer
than a horizon, so these alone tell when a value enters or leaves the trailing range. Rows then meet, per (source,
slot), the entries and exits of that slot and what was in range as it began. No row is carried into another slot, and the
largest task holds one slot of a source; the price is that the traffic is read three times instead of once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.functions.math import floor_div
from tapline.schema import SIGNAL_COLUMNS, port
from tapline.session import tasks_for

RULES = ("scan", "sweep", "beacon", "rst")
METHOD = "Behavioral Detection"


def _horizon(cfg: Config, rules) -> int:
    per_rule = {"scan": cfg.port_scan_us, "sweep": cfg.host_sweep_us,
                "beacon": cfg.beacon_us, "rst": cfg.rst_storm_us}
    return max(per_rule[r] for r in rules)


def chunked(df: DataFrame, horizon_us: int, chunk_us: int) -> DataFrame:
    """Assign rows to time chunks; a row near a chunk's end is also handed to the next chunk."""
    if horizon_us > chunk_us:
        raise ValueError("a chunk must be at least as long as the horizon")
    home = floor_div(F.col("ts_us"), chunk_us)
    spills = floor_div(F.col("ts_us") + F.lit(horizon_us), chunk_us) > home
    return (df.withColumn("_home", home)
            .withColumn("_chunk", F.explode(F.when(spills, F.array(F.col("_home"), F.col("_home") + 1))
                                            .otherwise(F.array(F.col("_home"))))))


def _base(df: DataFrame) -> DataFrame:
    return df.select(
        "ts_us", "event_id", "src_ip", "dst_ip", "src_port", "dst_port",
        F.upper("protocol").alias("protocol"), port("dst_port").alias("_dport"),
        F.coalesce(F.col("tcp_flags").contains("R"), F.lit(False)).alias("_rst"))


def _change(at: Column, slot: Column, delta: Column | int, eid: Column | None = None) -> Column:
    """Something that happens to a count: before the row ``eid`` of the same time, or before all rows of that time."""
    return F.struct(at.alias("at"), slot.alias("_slot"), (eid if eid is not None else F.lit(-(1 << 63))).cast("bigint").alias("eid"),
                    (delta if isinstance(delta, Column) else F.lit(delta)).cast("bigint").alias("d"))


def _changes(df: DataFrame, keys: list[str], changes: list[Column], began: Column, name: str) -> DataFrame:
    """Rows of ``changes`` (null: none) and ``began`` (an array), as the count ``name`` of the keys."""
    found = F.concat(F.filter(F.array(*changes), lambda x: x.isNotNull()), began)
    return df.select(*keys, F.explode(found).alias("_e")).select(
        *keys, "_e.at", "_e._slot", "_e.eid", F.col("_e.d").alias(name), F.lit(0).alias("is_row"))


def _in_range(first: Column, last: Column, slot_us: int, n: Column | int) -> Column:
    """A change at the start of every slot from ``first`` to ``last``."""
    none = F.array().cast("array<struct<at:bigint,_slot:bigint,eid:bigint,d:bigint>>")
    starts = F.transform(F.sequence(first, last), lambda k: _change(k * slot_us, k, n))
    return F.when(last >= first, starts).otherwise(none)


def _value_changes(spans: DataFrame, key: str, h: int, slot_us: int, name: str) -> DataFrame:
    """Changes of the number of values in range, per source and ``key``."""
    slot = lambda t: floor_div(t, slot_us)
    gone = F.col("last") + h
    enters = F.col("_prev").isNull() | (F.col("first.ts_us") - F.col("_prev") > h)
    leaves = (F.col("_next").isNull() | (F.col("_next") > gone)) & (slot(gone + 1) == slot(gone))  # else the next slot begins without it
    return _changes(spans, ["src_ip", key], [
        F.when(enters, _change(F.col("first.ts_us"), F.col("_slot"), 1, F.col("first.event_id"))),
        F.when(leaves, _change(gone + 1, slot(gone), -1)),
    ], _in_range(F.col("_slot") + 1, slot(F.least(gone, F.coalesce(F.col("_next"), gone))), slot_us, 1), name)


def slot_counts(df: DataFrame, cfg: Config, rules) -> DataFrame:
    """Every traffic row with its trailing counts, on two levels."""
    slot_us = cfg.behaviour_slot_us
    if slot_us > min({"scan": cfg.port_scan_us, "sweep": cfg.host_sweep_us, "rst": cfg.rst_storm_us}[r] for r in rules):
        raise ValueError("a slot must not be longer than a horizon")
    base = _base(df).withColumn("_slot", floor_div(F.col("ts_us"), slot_us))
    n = tasks_for(df)
    parts, counts = [base.withColumns({"at": F.col("ts_us"), "eid": F.col("event_id"), "is_row": F.lit(1)})], {}
    if "scan" in rules or "sweep" in rules:
        value = ["src_ip", "dst_ip", "_dport"]
        spans = base.groupBy(*value, "_slot").agg(F.min(F.struct("ts_us", "event_id")).alias("first"), F.max("ts_us").alias("last"))
        in_time = Window.partitionBy(*value).orderBy("_slot")
        spans = spans.repartition(n, *value).withColumns({"_prev": F.lag("last").over(in_time), "_next": F.lead("first.ts_us").over(in_time)})
        if "scan" in rules:
            parts.append(_value_changes(spans, "dst_ip", cfg.port_scan_us, slot_us, "d_scan"))
            counts["port_count"] = ("d_scan", "dst_ip")
        if "sweep" in rules:
            parts.append(_value_changes(spans, "_dport", cfg.host_sweep_us, slot_us, "d_sweep"))
            counts["host_count"] = ("d_sweep", "_dport")
    if "rst" in rules:
        gone = F.col("ts_us") + cfg.rst_storm_us
        until = floor_div(gone, slot_us)
        resets = base.filter("_rst")
        parts[0] = parts[0].withColumn("d_rst", F.col("_rst").cast("bigint"))
        ends = resets.filter(floor_div(gone + 1, slot_us) == until)
        parts.append(ends.groupBy("src_ip", (gone + 1).alias("at"), until.alias("_slot")).agg((-F.count(F.lit(1))).alias("d_rst"))
                     .withColumns({"eid": F.lit(-(1 << 63)).cast("bigint"), "is_row": F.lit(0)}))
        held = resets.groupBy("src_ip", "_slot", until.alias("_until")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(_changes(held, ["src_ip"], [F.lit(None).cast("struct<at:bigint,_slot:bigint,eid:bigint,d:bigint>")],
                              _in_range(F.col("_slot") + 1, F.col("_until"), slot_us, F.col("n")), "d_rst"))
        counts["rst_count"] = ("d_rst", None)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rows = rows.repartition(4 * n, "src_ip", "_slot")  # a row may bring changes to three counts

    def running(delta: str, key: str | None) -> Column:
        w = Window.partitionBy("src_ip", "_slot", *([key] if key else [])).orderBy("at", "eid", "is_row")
        return F.coalesce(F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))

    for name, (delta, key) in counts.items():
        rows = rows.withColumn(name, running(delta, key))
    return rows.filter("is_row = 1").select("ts_us", "event_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "_dport", *counts)


def behaviour_counts(df: DataFrame, cfg: Config = DEFAULT, rules=RULES) -> DataFrame:
    """Every traffic row with the trailing counts the requested rules compare to thresholds."""
    if cfg.behaviour_slot_us and "beacon" not in rules:
        return slot_counts(df, cfg, rules)
    rows = chunked(_base(df), _horizon(cfg, rules), cfg.chunk_us).repartition(tasks_for(df), "src_ip", "_chunk")

    pair_port = Window.partitionBy("src_ip", "_chunk", "dst_ip", "_dport").orderBy("ts_us", "event_id")
    prev_us, next_us = F.lag("ts_us").over(pair_port), F.lead("ts_us").over(pair_port)
    if "beacon" in rules:
        # A mean interval above the minimum bounds how many events can share the horizon, so a
        # fixed number of preceding rows decides the rule exactly.
        reach = cfg.beacon_us // cfg.beacon_min_mean_us
        recent = F.filter(F.collect_list("ts_us").over(pair_port.rowsBetween(-reach, 0)), lambda t: t >= F.col("ts_us") - cfg.beacon_us)
        rows = with_beacons(rows.withColumn("_recent", recent), cfg)
    rows = rows.withColumns({"_prev": prev_us, "_next": next_us})

    def enters(h: int) -> Column:
        return F.when(F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev") > h), F.lit(1)).otherwise(F.lit(0))

    def leaves(h: int) -> Column:
        return F.col("_next").isNull() | (F.col("_next") - F.col("ts_us") > h)

    # A row entry, then one expiry entry per rule at the first microsecond outside its horizon.
    keep = [c for c in rows.columns if c not in ("ts_us", "_prev", "_next")]

    def entry(at: Column, is_row: bool, scan: Column, sweep: Column, rst: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(1 if is_row else 0).alias("is_row"),
                        scan.alias("d_scan"), sweep.alias("d_sweep"), rst.alias("d_rst"))

    zero, minus = F.lit(0), F.lit(-1)
    rst_one = F.when(F.col("_rst"), F.lit(1)).otherwise(zero)
    entries = [entry(F.col("ts_us"), True,
                     enters(cfg.port_scan_us) if "scan" in rules else zero,
                     enters(cfg.host_sweep_us) if "sweep" in rules else zero,
                     rst_one if "rst" in rules else zero)]
    if "scan" in rules:
        entries.append(F.when(leaves(cfg.port_scan_us), entry(
            F.col("ts_us") + cfg.port_scan_us + 1, False, minus, zero, zero)))
    if "sweep" in rules:
        entries.append(F.when(leaves(cfg.host_sweep_us), entry(
            F.col("ts_us") + cfg.host_sweep_us + 1, False, zero, minus, zero)))
    if "rst" in rules:
        entries.append(F.when(F.col("_rst"), entry(
            F.col("ts_us") + cfg.rst_storm_us + 1, False, zero, zero, minus)))
    if set(rules) == {"beacon"}:
        out = rows
    else:
        exploded = rows.select(*keep, F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("_e"))
        out = exploded.select(*keep, "_e.*").withColumnRenamed("at", "ts_us")

        def running(delta: str, *extra: str) -> Column:
            w = (Window.partitionBy("src_ip", "_chunk", *extra).orderBy("ts_us", "is_row", "event_id")
                 .rowsBetween(Window.unboundedPreceding, 0))
            return F.sum(delta).over(w)

        counts = {}
        if "scan" in rules:
            counts["port_count"] = running("d_scan", "dst_ip")
        if "sweep" in rules:
            counts["host_count"] = running("d_sweep", "_dport")
        if "rst" in rules:
            counts["rst_count"] = running("d_rst")
        out = out.withColumns(counts).filter("is_row = 1")

    out = out.filter(F.col("_chunk") == F.col("_home"))
    return out.drop("_home", "_chunk", "_rst", "is_row", "d_scan", "d_sweep", "d_rst", "_prev", "_next")


def with_beacons(rows: DataFrame, cfg: Config) -> DataFrame:
    """Reduce `_recent`, the times of a service's preceding events, to the measures of the beacon rule."""
    n = F.size("_recent")
    gaps = F.transform(F.sequence(F.lit(2), n), lambda i: (
        F.element_at("_recent", i) - F.element_at("_recent", i - 1)).cast("double"))
    enough = n >= cfg.beacon_min_events
    mean = F.when(enough, (F.col("ts_us") - F.element_at("_recent", 1)) / (n - 1))
    out = rows.withColumns({"beacon_intervals": F.when(enough, n - 1), "_mean": mean})
    # Dense traffic fails on the mean alone and never has its gaps looked at.
    out = out.withColumn("_gaps", F.when(F.col("_mean") > cfg.beacon_min_mean_us, gaps))
    var = F.aggregate("_gaps", F.lit(0.0), lambda a, g: a + (g - F.col("_mean")) * (g - F.col("_mean")))
    cv = F.sqrt(var / F.size("_gaps")) / F.col("_mean")
    return out.withColumns({
        "beacon_mean_s": F.col("_mean") / 1e6,
        "beacon_cv": F.when(F.col("_mean") > cfg.beacon_min_mean_us, cv),
    }).drop("_recent", "_gaps", "_mean")


def _signal(category: str, severity: str, score: float, seq: int, dst: Column, dport: Column,
            protocol: Column, evidence: Column) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(METHOD).alias("detection_method"),
        F.lit(severity).alias("severity"), F.col("src_ip").alias("src_ip"), dst.alias("dst_ip"),
        F.lit(None).cast("int").alias("src_port"), dport.alias("dst_port"), protocol.alias("protocol"),
        evidence.alias("evidence"), F.lit(score).alias("score"), F.col("ts_us").alias("ts_us"),
        F.col("event_id").alias("event_id"), F.lit(seq).alias("seq"))


def _seconds(us: int) -> str:
    return f"{us / 1e6:.1f}s"


def behavioural_signals(df: DataFrame, cfg: Config = DEFAULT, rules=RULES) -> DataFrame:
    """Zero to four signals per traffic row."""
    counted = tuple(r for r in rules if r != "beacon")
    if not cfg.behaviour_slot_us or not counted or "beacon" not in rules:
        return _hits(behaviour_counts(df, cfg, rules), cfg, rules)
    return _hits(behaviour_counts(df, cfg, counted), cfg, counted).unionByName(
        _hits(behaviour_counts(df, cfg, ("beacon",)), cfg, ("beacon",)))


def _hits(c: DataFrame, cfg: Config, rules) -> DataFrame:
    proto, none = F.col("protocol"), F.lit(None).cast("int")
    hits = []
    if "scan" in rules:
        hits.append(F.when(F.col("port_count") >= cfg.port_scan_ports, _signal(
            "PORT_SCAN", "HIGH", 0.85, 10, F.col("dst_ip"), none, proto,
            F.concat(F.lit("Host probed "), F.col("port_count"), F.lit(" unique destination ports on "),
                     F.col("dst_ip"), F.lit(f" within {_seconds(cfg.port_scan_us)} "
                                            f"(Threshold: {cfg.port_scan_ports})")))))
    if "sweep" in rules:
        hits.append(F.when(F.col("host_count") >= cfg.host_sweep_hosts, _signal(
            "NETWORK_SWEEP", "HIGH", 0.80, 11, F.lit("multiple"), F.col("_dport"), proto,
            F.concat(F.lit("Host swept "), F.col("host_count"), F.lit(" distinct IP addresses on port "),
                     F.col("_dport"), F.lit(f" within {_seconds(cfg.host_sweep_us)}")))))
    if "beacon" in rules:
        hits.append(F.when(F.col("beacon_cv") < cfg.beacon_max_jitter, _signal(
            "BEACONING", "HIGH", 0.88, 12, F.col("dst_ip"), F.col("_dport"), proto,
            F.format_string(f"Regular periodic communication detected (%d intervals, mean=%.2fs, "
                            f"jitter_cv=%.3f < {cfg.beacon_max_jitter})",
                            F.col("beacon_intervals"), F.col("beacon_mean_s"), F.col("beacon_cv")))))
    if "rst" in rules:
        hits.append(F.when(F.col("rst_count") >= cfg.rst_storm_count, _signal(
            "CONNECTION_ANOMALY", "MEDIUM", 0.65, 13, F.col("dst_ip"), none, F.lit("TCP"),
            F.concat(F.lit("Excessive connection resets ("), F.col("rst_count"),
                     F.lit(f" TCP RST packets in < {cfg.rst_storm_us // 1_000_000}s)")))))
    return (c.select(F.explode(F.filter(F.array(*hits), lambda s: s.isNotNull())).alias("s"))
            .select("s.*").select(*SIGNAL_COLUMNS))


def port_scans(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return behavioural_signals(df, cfg, ("scan",))


def host_sweeps(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return behavioural_signals(df, cfg, ("sweep",))


def beacons(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return behavioural_signals(df, cfg, ("beacon",))


def rst_storms(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return behavioural_signals(df, cfg, ("rst",))
