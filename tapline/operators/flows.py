"""Bidirectional flow sessions.

A flow ends after an idle gap, after a reset, or when a sweep finds it too old. Sweeps run on a
fixed grid (every five seconds), so whether a flow is too old at a sweep depends only on the sweep
interval in which it began; the age rule therefore needs one row per key and interval.

Packets are reduced to fragments first: one per (endpoint pair, time slice, reset segment), in one shuffle and one
sort, so a pair that sends a third of all packets is spread over the slices it sends in. Sessions are then
built from fragments, of which a key has one per slice and reset, however many packets it carries. Fragments
are ordered by their first packet and may be cut anywhere, which lets a stream hand on those of open flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.functions.math import floor_div
from tapline.operators import greedy
from tapline.schema import port

KEY = ["ip_a", "port_a", "ip_b", "port_b", "proto"]

# What a packet's flags do to the connection state; an acknowledgement alone only completes a
# handshake, every other operation sets the state outright.
SET_SYN, SET_SYNACK, SET_RST, SET_FIN, ACK = "SYN_SENT", "SYN_RCVD", "RESET", "FIN_WAIT", "ACK"


def tcp_operation(proto: Column, flags: Column) -> Column:
    f = F.coalesce(flags, F.lit(""))
    s, a = f.contains("S"), f.contains("A")
    return F.when((proto == "TCP") & (f != ""), F.when(s & ~a, F.lit(SET_SYN)).when(s, F.lit(SET_SYNACK))
                  .when(f.contains("R"), F.lit(SET_RST)).when(f.contains("F"), F.lit(SET_FIN))
                  .when(a, F.lit(ACK)))


def canonical(df: DataFrame) -> DataFrame:
    """Order the two endpoints of each packet so both directions share one key."""
    src = F.struct(F.col("src_ip").alias("ip"), port("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), port("dst_port").alias("port"))
    proto = F.upper("protocol")
    out = df.withColumns({"_s": src, "_d": dst, "proto": proto})
    a, b = F.least("_s", "_d"), F.greatest("_s", "_d")
    return out.withColumns({
        "ip_a": a["ip"], "port_a": a["port"], "ip_b": b["ip"], "port_b": b["port"],
        "_ab": F.col("_s") == a, "_op": tcp_operation(F.col("proto"), F.col("tcp_flags")),
    }).drop("_s", "_d")


def _last_text(name: str) -> Column:
    return F.max(F.when(F.col(name) != "", F.struct("ts_us", "event_id", F.col(name).alias("v")))).alias(name)


def with_fields(df: DataFrame) -> DataFrame:
    """Application fields as columns, taken from the metadata where they are not there yet."""
    for name in ("app_protocol", "tls_sni", "dns_query"):
        if name not in df.columns:
            from_meta = (F.try_variant_get("metadata", f"$.{name}", "string") if "metadata" in df.columns
                         else F.lit(None).cast("string"))
            df = df.withColumn(name, from_meta)
    return df


def fragments(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    df = with_fields(df)
    p = canonical(df).withColumn("_slice", floor_div(F.col("ts_us"), cfg.flow_slice_us))
    p = p.select(*KEY, "_slice", "ts_us", "event_id", "_ab", "_op", "packet_len", "tcp_flags",
                 "app_protocol", "tls_sni", "dns_query")
    # Segments end with a reset. All their values are running values of the slice, less those at the segment's start.
    w = Window.partitionBy(*KEY, "_slice").orderBy("ts_us", "event_id")
    running, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    p = p.withColumns({
        "_seg": F.coalesce(one(F.col("_op") == SET_RST).over(earlier), F.lit(0)),
        "_starts": F.coalesce(F.lag("_op").over(w) == SET_RST, F.row_number().over(w) == 1),
        "_row": F.row_number().over(w), "_prev_us": F.lag("ts_us").over(w), "_abs": one(F.col("_ab")).over(running),
        "_op_before": F.last("_op", ignorenulls=True).over(earlier),
    })
    p = p.withColumns({
        "_row0": F.max(F.when(F.col("_starts"), F.col("_row") - 1)).over(running),
        "_ab0": F.max(F.when(F.col("_starts"), F.col("_abs") - F.when(F.col("_ab"), 1).otherwise(0))).over(running),
        "_iat": F.when(~F.col("_starts"), F.col("ts_us") - F.col("_prev_us")),
        "_before": F.when(F.col("_op_before") != SET_RST, F.col("_op_before")),
    })
    forward = F.col("_abs") - F.col("_ab0")
    p = p.withColumns({"_n": F.col("_row") - F.col("_row0")}).withColumn(
        "_nd", F.when(F.col("_ab"), forward).otherwise(F.col("_n") - forward)).withColumn(
        "_pane", floor_div(F.col("ts_us"), cfg.flow_sweep_us))
    order = F.struct("ts_us", "event_id")
    size = F.coalesce("packet_len", F.lit(0))
    isop = lambda *names: F.col("_op").isin(*names)

    def first_lengths(ab: bool) -> Column:
        return F.array_sort(F.collect_list(F.when(
            (F.col("_ab") == ab) & (F.col("_nd") <= cfg.flow_len_keep), F.struct("_nd", size.alias("v")))))

    return p.groupBy(*KEY, "_slice", "_seg").agg(
        F.min("_pane").alias("_pane"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.min(F.struct("ts_us", "event_id", "_ab")).alias("_open"),
        F.count(F.when(F.col("_ab"), 1)).alias("ab_packets"), F.count(F.when(~F.col("_ab"), 1)).alias("ba_packets"),
        F.sum(F.when(F.col("_ab"), size).otherwise(0)).alias("ab_bytes"),
        F.sum(F.when(~F.col("_ab"), size).otherwise(0)).alias("ba_bytes"),
        first_lengths(True).alias("ab_lengths"), first_lengths(False).alias("ba_lengths"),
        F.array_sort(F.collect_list(F.when((F.col("_n") > 1) & (F.col("_n") <= cfg.flow_iat_keep + 1),
                                           F.struct("_n", F.col("_iat").alias("v"))))).alias("_iats"),
        F.count(F.when(isop(SET_SYN, SET_SYNACK), 1)).alias("syn_count"),
        F.count(F.when(isop(SET_RST), 1)).alias("rst_count"),
        F.count(F.when(isop(SET_FIN), 1)).alias("fin_count"),
        F.count(F.when(isop(SET_SYNACK) | (isop(ACK) & (F.col("_before") == SET_SYNACK)), 1)).alias("_acks"),
        F.min_by("_op", F.when(F.col("_op").isNotNull(), order)).alias("_first_op"),
        F.max_by("_op", F.when(F.col("_op").isNotNull(), order)).alias("_last_op"),
        # Last state-setting operation, and whether an acknowledgement directly completed it.
        F.max(F.when(F.col("_op").isNotNull() & (F.col("_op") != ACK), F.struct("ts_us", "event_id", "_op")))
        .alias("_set"),
        F.max(F.when(isop(ACK), order)).alias("_ack_at"),
        F.collect_set(F.when((F.col("proto") == "TCP") & (F.col("tcp_flags") != ""), F.col("tcp_flags")))
        .alias("_flags"),
        _last_text("app_protocol"), _last_text("tls_sni"), _last_text("dns_query")).drop("_slice", "_seg")


def _age_starts(base: DataFrame, cfg: Config) -> DataFrame:
    """Add ``_flow_pane``: the sweep interval in which the row's flow began.

    A flow that began in interval p is first too old at the sweep opening interval p + age + 1.
    """
    reach = cfg.flow_age_us // cfg.flow_sweep_us + 1
    bkey = [*KEY, "_base"]
    long_lived = base.groupBy(*bkey).agg(F.min("_pane").alias("_p0"), F.max("_pane").alias("_p1"))
    # Only sessions that outlive the age limit are looked at, by their occupied intervals.
    panes = (base.join(long_lived.filter(F.col("_p1") - F.col("_p0") >= reach), bkey).select(*bkey, "_pane").distinct())
    spans = greedy.spaced(panes, bkey, "_pane", reach).withColumnRenamed("_pane", "_flow_pane")
    marked = spans.withColumn("_pane", F.col("_flow_pane"))
    joined = base.join(marked, [*bkey, "_pane"], "left")
    w = (Window.partitionBy(*bkey).orderBy("_open")
         .rowsBetween(Window.unboundedPreceding, 0))
    first_pane = F.min("_pane").over(w)
    return joined.withColumn("_flow_pane", F.coalesce(F.last("_flow_pane", ignorenulls=True).over(w), first_pane))


def assigned(frag: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add `_base` and `_flow_pane`, which with the key name the session of a fragment."""
    w = Window.partitionBy(*KEY).orderBy("_open")
    prev_last, prev_rst = F.lag("last_us").over(w), F.lag("rst_count").over(w)
    opens = F.coalesce((F.col("first_us") - prev_last > cfg.flow_idle_us) | (prev_rst > 0), F.lit(True))
    base = frag.withColumn("_base", F.last(F.when(opens, F.col("_open")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    return _age_starts(base, cfg)


SESSION = [*KEY, "_base", "_flow_pane"]


def flow_sessions(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per flow session."""
    return sessions(assigned(fragments(df, cfg), cfg), cfg)


def sessions(aged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Flow rows from the fragments of `assigned`."""
    wf = Window.partitionBy(*SESSION).orderBy("_open")
    before = F.last("_last_op", ignorenulls=True).over(wf.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("first_us") - F.lag("last_us").over(wf)
    aged = aged.withColumns({
        # The opening packet has gap zero; later fragments open with the gap to their predecessor.
        "_lead": F.coalesce(gap, F.lit(0).cast("bigint")),
        "_ack_join": F.when((F.col("_first_op") == ACK) & F.coalesce(before == SET_SYNACK, F.lit(True)), 1).otherwise(0),
    })
    pieces = lambda name: F.flatten(F.transform(  # noqa: E731  (at most one fragment per slice of the age limit, and per reset)
        F.array_sort(F.collect_list(F.struct("_open", F.col(name).alias("x")))), lambda s: s["x"]))
    aged = aged.withColumns({
        "_all_iats": F.concat(F.array("_lead"), F.transform("_iats", lambda x: x["v"])),
        "_ab_len": F.transform("ab_lengths", lambda x: x["v"]),
        "_ba_len": F.transform("ba_lengths", lambda x: x["v"]),
    })
    g = aged.groupBy(*SESSION).agg(
        F.min("first_us").alias("start_us"), F.max("last_us").alias("last_us"),
        F.min("_open")["_ab"].alias("_open_ab"),
        *[F.sum(c).alias(c) for c in ("ab_packets", "ba_packets", "ab_bytes", "ba_bytes",
                                      "syn_count", "rst_count", "fin_count")],
        (F.sum("_acks") + F.sum("_ack_join")).cast("bigint").alias("ack_count"),
        F.max("_set").alias("_set"), F.max("_ack_at").alias("_ack_at"),
        F.flatten(F.collect_list("_flags")).alias("_flags"),
        F.slice(pieces("_all_iats"), 1, cfg.flow_iat_keep).alias("_iats"),
        F.slice(pieces("_ab_len"), 1, cfg.flow_len_keep).alias("_ab_len"),
        F.slice(pieces("_ba_len"), 1, cfg.flow_len_keep).alias("_ba_len"),
        *[F.max(c)["v"].alias(c) for c in ("app_protocol", "tls_sni", "dns_query")])
    o = F.col("_open_ab")
    pick = lambda x, y: F.when(o, F.col(x)).otherwise(F.col(y))
    set_op = F.col("_set._op")
    acked = F.col("_ack_at") > F.struct(F.col("_set.ts_us").alias("ts_us"), F.col("_set.event_id").alias("event_id"))
    state = (F.when(set_op.isNull(), F.when(F.col("_ack_at").isNotNull(), F.lit("ESTABLISHED")).otherwise(F.lit("UNKNOWN")))
             .when((set_op == SET_SYNACK) & acked, F.lit("ESTABLISHED")).otherwise(set_op))
    total_p, total_b = F.col("ab_packets") + F.col("ba_packets"), F.col("ab_bytes") + F.col("ba_bytes")
    dur = (F.col("last_us") - F.col("start_us")) / 1e6
    letters = F.array_distinct(F.split(F.array_join("_flags", ""), ""))
    return g.select(
        F.concat(F.lit("flow_"), F.expr("start_us div 1000"), F.lit("_"), pick("port_a", "port_b"), F.lit("_"),
                 pick("port_b", "port_a")).alias("flow_id"),
        pick("ip_a", "ip_b").alias("src_ip"), pick("ip_b", "ip_a").alias("dst_ip"),
        pick("port_a", "port_b").alias("src_port"), pick("port_b", "port_a").alias("dst_port"),
        F.col("proto").alias("protocol"), "start_us", "last_us", dur.alias("duration"),
        pick("ab_packets", "ba_packets").alias("fwd_packets"), pick("ba_packets", "ab_packets").alias("bwd_packets"),
        pick("ab_bytes", "ba_bytes").alias("fwd_bytes"), pick("ba_bytes", "ab_bytes").alias("bwd_bytes"),
        total_p.alias("total_packets"), total_b.alias("total_bytes"),
        F.when(dur > 0, total_p / dur).otherwise(total_p.cast("double")).alias("pps"),
        F.when(dur > 0, total_b / dur).otherwise(total_b.cast("double")).alias("bps"),
        state.alias("tcp_state"), F.array_join(F.array_sort(letters), "").alias("flags"),
        "syn_count", "ack_count", "rst_count", "fin_count", "app_protocol", "tls_sni", "dns_query",
        F.transform("_iats", lambda x: x / 1e6).alias("inter_arrival_times"),
        pick("_ab_len", "_ba_len").alias("fwd_lengths"), pick("_ba_len", "_ab_len").alias("bwd_lengths"))


def mark_active(flows: DataFrame, now_us: int | Column | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Flag flows still open at ``now_us`` (default: the newest packet seen).

    The default computes the flows twice; the newest packet of the traffic as a scalar column does not.
    """
    now = flows.agg(F.max("last_us")).scalar() if now_us is None else now_us if isinstance(now_us, Column) else F.lit(now_us)
    open_ = ((now - F.col("last_us") <= cfg.flow_idle_us) & (now - F.col("start_us") <= cfg.flow_age_us)
             & ~F.col("tcp_state").isin("RESET", "CLOSED"))
    return flows.withColumn("active", open_)


def active_flows(flows: DataFrame, limit: int = 100, now_us: int | Column | None = None, cfg: Config = DEFAULT) -> DataFrame:
    return (mark_active(flows, now_us, cfg).filter("active").drop("active")
            .orderBy(F.desc("last_us"), "flow_id").limit(limit))


def flow_stats(flows: DataFrame, now_us: int | Column | None = None, cfg: Config = DEFAULT) -> DataFrame:
    return mark_active(flows, now_us, cfg).agg(
        F.count_if("active").alias("active_flow_count"), F.count_if(~F.col("active")).alias("completed_flow_count"))
