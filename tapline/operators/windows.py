"""Sliding windows built from small time slots.

A window holds the events of (end - size, end]. Events are never copied into the windows they
belong to. They are aggregated once into slots (100 ms by default; a divisor of the slide), and slot
rows, a few dozen per window whatever the event rate, are combined into windows. Values whose
distinct counts or entropies are needed are counted per (slide interval, field, value) first.

``group_cols`` gives every group its own windows; without it windows span all traffic. ``whole``
treats each group as one window, which is how labelled event sets are evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.functions.math import floor_div, moment_partial
from tapline.schema import port

# Industrial ports and ports associated with command channels.
OT_PORTS = [502, 102, 20000, 44818, 4840]
COMMAND_PORTS = [4444, 1337, 8443, 9001]

FIELDS = ["flow", "dport", "dst", "src", "subnet", "ip_id", "ip_flags", "tcp_flags", "dscp", "ttl", "proto"]


def slot_of(cfg: Config) -> Column:
    """Slot k covers (origin + (k-1) * slot, origin + k * slot]."""
    return floor_div(F.col("ts_us") - cfg.origin_us - 1, cfg.slot_us) + 1


def _check(cfg: Config) -> None:
    if cfg.slide_us % cfg.slot_us or cfg.window_us % cfg.slide_us:
        raise ValueError("the slot must divide the slide and the slide must divide the window")


def _ends(first_pane: Column, cfg: Config) -> Column:
    panes = F.sequence(first_pane, first_pane + (cfg.window_us // cfg.slide_us - 1))
    return F.transform(panes, lambda k: k * cfg.slide_us + cfg.origin_us)


def ends_of_slot(slot: Column, cfg: Config) -> Column:
    return _ends(pane_of_slot(slot, cfg), cfg)


def explode_slots(slots: DataFrame, cfg: Config, whole: bool) -> DataFrame:
    end = F.lit(0).cast("bigint") if whole else F.explode(ends_of_slot(F.col("slot"), cfg))
    return slots.withColumn("window_end", end)


def complete_only(windows: DataFrame, df: DataFrame, emit_partial: bool = False) -> DataFrame:
    """Drop windows that end after the newest event, which are not due yet."""
    if emit_partial:
        return windows
    return windows.filter(F.col("window_end") <= df.agg(F.max("ts_us")).scalar())


def slot_capacity(cfg: Config) -> int:
    """Events a slot may hold for its window to be transformed as one array."""
    return max(1, cfg.fft_array_limit // (cfg.window_us // cfg.slot_us))


def slots(df: DataFrame, cfg: Config = DEFAULT, group_cols: tuple[str, ...] = (), times: bool = False,
          tasks: int | None = None) -> DataFrame:
    """One row per occupied slot with everything windows can combine; ``tasks`` sets how many share the events."""
    _check(cfg)
    have = set(df.columns)
    false = F.lit(False)
    p = df.select(
        *group_cols, "ts_us", "event_id", "src_ip", "dst_ip", "src_port", "dst_port",
        (F.col("asset_id") if "asset_id" in have else F.lit(None).cast("string")).alias("_asset"),
        "data_source" if "data_source" in have else F.lit(None).cast("string").alias("data_source"),
        F.upper("protocol").alias("protocol"), F.coalesce("packet_len", F.lit(0)).alias("packet_len"), "ttl",
        F.coalesce("tcp_flags", F.lit("")).alias("flags"),
        "altered" if "altered" in have else false.alias("altered"),
        "spoofed" if "spoofed" in have else false.alias("spoofed"),
        F.when((port("src_port") == 502) | (port("dst_port") == 502), F.nullif("payload_hex", F.lit("")))
        .alias("modbus_hex"),
        slot_of(cfg).alias("slot"))
    if tasks:
        p = p.repartition(tasks, *group_cols, "slot")
    w = Window.partitionBy(*group_cols, "slot").orderBy("ts_us", "event_id")
    prev = F.lag("ts_us").over(w)
    if cfg.iat_mode == "double":
        iat = F.col("ts_us") / 1e6 - prev / 1e6
    else:
        iat = (F.col("ts_us") - prev).cast("double")
    p = p.withColumn("_iat", iat)
    at = F.struct("ts_us", "event_id")
    dport = F.col("dst_port")
    ot = dport.isin(OT_PORTS)
    seen = lambda c: F.coalesce(F.max(c), F.lit(False))

    def first_of(name: str) -> Column:
        return F.min(F.when(F.col(name).isNotNull(), F.struct("ts_us", "event_id", F.col(name).alias("v"))))

    aggs = [
        F.count(F.lit(1)).alias("n"), F.sum("packet_len").alias("bytes"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        moment_partial(F.col("packet_len").cast("double")).alias("len_m"), moment_partial("_iat").alias("iat_m"),
        F.count("ttl").alias("ttl_n"), F.sum("ttl").alias("ttl_sum"), F.min("ttl").alias("ttl_min"),
        F.max("ttl").alias("ttl_max"),
        *[F.count_if(F.col("protocol") == x.upper()).alias(f"{x}_n") for x in ("tcp", "udp", "icmp")],
        *[F.count_if(F.col("flags").contains(ch)).alias(f"{name}_n") for name, ch in (("syn", "S"), ("rst", "R"))],
        F.count_if("altered").alias("altered_n"), F.count_if("spoofed").alias("spoofed_n"),
        seen(ot).alias("has_ot"),
        seen(dport.isin(COMMAND_PORTS) | (~ot & (dport > 1024))).alias("has_command"),
        F.min(F.struct("ts_us", "event_id", "src_ip", "dst_ip", "src_port", "dst_port",
                       F.col("_asset").alias("asset_id"))).alias("head"),
        F.max(F.struct("ts_us", "event_id", "data_source")).alias("tail"),
        first_of("src_port").alias("head_sport"), first_of("dst_port").alias("head_dport"),
        first_of("modbus_hex").alias("head_modbus"),
    ]
    if times:
        # Only slots small enough to be sent as arrays carry their arrival times.
        aggs.append(F.when(F.count(F.lit(1)) <= slot_capacity(cfg), F.array_sort(F.collect_list(
            F.when(F.col("_rn") <= slot_capacity(cfg), F.col("ts_us"))))).alias("times"))
        p = p.withColumn("_rn", F.row_number().over(w))
    return p.groupBy(*group_cols, "slot").agg(*aggs)


def pane_counts(df: DataFrame, cfg: Config = DEFAULT, group_cols: tuple[str, ...] = (),
                fields: list[str] | None = None, whole: bool = False, tasks: int | None = None) -> DataFrame:
    """Occurrences per (slide interval, field, value); all fields share one pass.

    Protocols also have `seen`, which breaks ties between them; without them the column is left out. With ``tasks`` the events are dealt out by slot, counted there, and the counts of slots dealt out by value.
    """
    _check(cfg)
    text = {
        "flow": F.concat_ws("|", "src_ip", "dst_ip", F.coalesce(F.col("src_port").cast("string"), F.lit("-")),
                            F.coalesce(F.col("dst_port").cast("string"), F.lit("-")), "protocol"),
        "dport": F.col("dst_port").cast("string"), "dst": F.col("dst_ip"), "src": F.col("src_ip"),
        "subnet": F.when(F.col("dst_ip").contains("."), F.regexp_extract("dst_ip", r"^(.*)\.[^.]*$", 1)),
        "ip_id": F.col("ip_id").cast("string") if "ip_id" in df.columns else F.lit(None).cast("string"),
        "ip_flags": F.col("ip_flags").cast("string") if "ip_flags" in df.columns else F.lit(None).cast("string"),
        "tcp_flags": F.nullif("tcp_flags", F.lit("")),
        "dscp": F.col("dscp").cast("string") if "dscp" in df.columns else F.lit(None).cast("string"),
        "ttl": F.col("ttl").cast("string"), "proto": F.upper("protocol"),
    }
    # Order of first appearance, needed only to break ties between protocols. A decimal keeps the
    # hash aggregate, which a struct buffer would turn into a sort.
    seen_at = F.col("ts_us").cast("decimal(38,0)") * F.lit(1 << 62) + F.col("event_id")
    fields = fields or FIELDS
    seen = {name: (seen_at if name == "proto" else F.lit(None)).cast("decimal(38,0)").alias("seen") for name in fields}
    entries = [F.struct(F.lit(name).alias("field"), text[name].alias("value"), *([seen[name]] if "proto" in fields else []))
               for name in fields]
    pane = F.lit(0).cast("bigint") if whole else floor_div(F.col("ts_us") - cfg.origin_us - 1, cfg.slide_us) + 1
    keys = [*group_cols, "pane", "field", "value"]
    first = [F.min("seen").alias("seen")] if "proto" in fields else []
    counted = [F.count(F.lit(1)).alias("n"), *first]
    if not tasks or whole:
        rows = df.select(*group_cols, pane.alias("pane"), F.explode(F.array(*entries)).alias("e"))
        return rows.select(*group_cols, "pane", "e.*").filter("value IS NOT NULL").groupBy(*keys).agg(*counted)
    rows = (df.withColumn("_slot", slot_of(cfg)).repartition(tasks, *group_cols, "_slot")
            .select(*group_cols, "_slot", pane.alias("pane"), F.explode(F.array(*entries)).alias("e"))
            .select(*group_cols, "_slot", "pane", "e.*").filter("value IS NOT NULL"))
    by_slot = rows.groupBy("_slot", *keys).agg(*counted).drop("_slot")
    return by_slot.repartition(tasks, *keys).groupBy(*keys).agg(F.sum("n").alias("n"), *first)


def dealt(rows: DataFrame, first_pane: Column, cfg: Config, keys: list[str], tasks: int) -> DataFrame:
    """Every row for each window of its slide interval, as `window_end`, in ``tasks`` tasks by ``keys`` and `_chunk`.

    A task gets the rows of a chunk of twice as many windows as an interval belongs to, so a row is sent once or twice and
    multiplied where it is used.
    """
    span = cfg.window_us // cfg.slide_us
    size, last = 2 * span, F.col("_first") + (span - 1)
    ends = F.sequence(F.greatest(F.col("_first"), F.col("_chunk") * size), F.least(last, F.col("_chunk") * size + (size - 1)))
    return (rows.withColumn("_first", first_pane)
            .withColumn("_chunk", F.explode(F.sequence(floor_div(F.col("_first"), size), floor_div(last, size))))
            .repartition(tasks, *keys, "_chunk")
            .withColumn("window_end", F.explode(F.transform(ends, lambda k: k * cfg.slide_us + cfg.origin_us))).drop("_first"))


#: Parts over which the values of a window are counted.
VALUE_PARTS = 8
#: Columns that tell in which of the parts of a window its counts lie.
PLACES = ["_part", "_chunk"]


def window_counts(per_pane: DataFrame, cfg: Config = DEFAULT, group_cols: tuple[str, ...] = (), tasks: int | None = None,
                  parts: bool = False) -> DataFrame:
    """Occurrences per (window, field, value) from those of its slide intervals; ``parts`` keeps ``PLACES``."""
    sums = [F.sum("n").alias("n"), *([F.min("seen").alias("seen")] if "seen" in per_pane.columns else [])]
    if not tasks:
        return (per_pane.withColumn("window_end", F.explode(_ends(F.col("pane"), cfg)))
                .groupBy(*group_cols, "window_end", "field", "value").agg(*sums))
    part = F.pmod(F.xxhash64("field", "value"), F.lit(VALUE_PARTS))
    rows = dealt(per_pane.withColumn("_part", part), F.col("pane"), cfg, [*group_cols, "_part"], tasks)
    return rows.groupBy(*group_cols, *PLACES, "window_end", "field", "value").agg(*sums).drop(*([] if parts else PLACES))


def value_counts(df: DataFrame, cfg: Config = DEFAULT, group_cols: tuple[str, ...] = (),
                 fields: list[str] | None = None, whole: bool = False, tasks: int | None = None, parts: bool = False) -> DataFrame:
    """Occurrences per (window, field, value)."""
    per_pane = pane_counts(df, cfg, group_cols, fields, whole, tasks)
    return per_pane.withColumnRenamed("pane", "window_end") if whole else window_counts(per_pane, cfg, group_cols, tasks, parts)


def last_end(pane: Column, cfg: Config) -> Column:
    """End of the last window that holds a slide interval."""
    return (pane + (cfg.window_us // cfg.slide_us - 1)) * cfg.slide_us + cfg.origin_us


def pane_of_slot(slot: Column, cfg: Config) -> Column:
    return floor_div(slot - 1, cfg.slide_us // cfg.slot_us) + 1


def entropy_sums(n: Column, when: Column) -> dict[str, Column]:
    """Aggregates that add up: what the entropy of counts is made of."""
    return {"total": F.sum(F.when(when, n)), "logs": F.sum(F.when(when, n * F.log2(n)))}


def entropy_of(total: Column, logs: Column) -> Column:
    """Shannon entropy in bits, as log2(total) - sum(n log2 n) / total."""
    return F.greatest(F.lit(0.0), F.coalesce(F.log2(total) - logs / total, F.lit(0.0)))


def entropy_bits(n: Column, when: Column) -> Column:
    """Aggregate: Shannon entropy of counts."""
    return entropy_of(**entropy_sums(n, when))
