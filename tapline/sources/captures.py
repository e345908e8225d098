"""Exports of packet analysers and connection loggers: tshark rows and Zeek conn.log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions.math import pin
from tapline.schema import with_event_id, with_event_time
from tapline.sources import files

# The field list of a tab-separated export, in column order.
TSHARK_FIELDS = ["frame.time_epoch", "ip.src", "ip.dst", "tcp.srcport", "tcp.dstport", "udp.srcport",
                 "udp.dstport", "_ws.col.Protocol", "frame.len", "ip.ttl", "ip.id", "ip.flags", "tcp.flags"]
# Metadata keys holding payload, and the statuses of a failed checksum.
PAYLOAD_TOKENS = ["payload", "data.data", "tcp.segment_data"]
CHECKSUM_FIELDS = ["ip.checksum.status", "tcp.checksum.status", "udp.checksum.status"]
BAD_CHECKSUM = ["bad", "invalid", "0", "false"]
# The columns of a conn.log without a header.
ZEEK_FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration",
               "orig_bytes", "resp_bytes"]


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint"))


def _epoch(c: Column) -> Column:
    seconds = F.trim(c).try_cast("double")
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 2.5e11)
    return F.coalesce(F.when(ok, F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))), F.current_timestamp())


def tshark_rows(df: DataFrame, row: str = "row", source: str = "tshark") -> DataFrame:
    """Typed events from a MAP<STRING, STRING> column of analyser fields."""
    def get(name: str) -> Column:
        return F.try_element_at(F.col(row), F.lit(name))

    def either(*names: str) -> Column:
        return F.coalesce(*[F.nullif(get(n), F.lit("")) for n in names])

    kept = F.map_filter(F.col(row), lambda k, v: ~F.exists(
        F.array(*[F.lit(t) for t in PAYLOAD_TOKENS]), lambda t: F.lower(k).contains(t)))
    df = pin(df.select(row), {
        "_time": either("frame.time_epoch", "timestamp"), "_src": get("ip.src"), "_dst": get("ip.dst"),
        "_sport": either("tcp.srcport", "udp.srcport"), "_dport": either("tcp.dstport", "udp.dstport"),
        "_proto": either("_ws.col.Protocol", "protocol"), "_len": get("frame.len"), "_ttl": get("ip.ttl"),
        "_id": get("ip.id"), "_doc": F.to_json(kept),
        "_sum": F.lower(F.coalesce(either(*CHECKSUM_FIELDS), F.lit(""))),
    })
    noted = F.concat(F.expr("substring(_doc, 1, length(_doc) - 1)"),
                     F.when(F.col("_doc") == "{}", F.lit("")).otherwise(F.lit(",")), F.lit('"checksum_valid":false}'))
    doc = F.when(F.col("_sum").isin(BAD_CHECKSUM), noted).otherwise(F.col("_doc"))
    out = df.select(
        _epoch(F.col("_time")).alias("timestamp"),
        F.coalesce("_src", F.lit("0.0.0.0")).alias("src_ip"), F.coalesce("_dst", F.lit("0.0.0.0")).alias("dst_ip"),
        _int(F.col("_sport")).cast("int").alias("src_port"), _int(F.col("_dport")).cast("int").alias("dst_port"),
        F.coalesce("_proto", F.lit("TCP")).alias("protocol"),
        F.coalesce(_int(F.col("_len")), F.lit(0)).alias("packet_len"),
        _int(F.col("_ttl")).cast("int").alias("ttl"), _int(F.col("_id")).cast("int").alias("ip_id"),
        F.lit(None).cast("int").alias("ip_flags"), F.lit(None).cast("string").alias("tcp_flags"),
        F.lit(None).cast("int").alias("dscp"), F.lit(None).cast("string").alias("payload_hex"),
        F.lit(source).alias("data_source"), F.lit(None).cast("string").alias("asset_id"),
        F.parse_json(doc).alias("metadata"))
    return with_event_id(with_event_time(out))


def read_tshark_json(spark: SparkSession, path: str) -> DataFrame:
    """An analyser JSON export: layer values that are lists count as their first element.

    Elements of the exported array are found at line starts, so one export is read by as many tasks as it has splits.
    Rows may nest their fields under `_source.layers` or hold them directly.
    """
    element = F.col("element")

    def first(_, x):
        # An empty list has no first element and stays a list, which no typed field accepts.
        listed = F.schema_of_variant(x).startswith("ARRAY")
        return F.coalesce(F.when(listed, F.try_variant_get(x, "$[0]", "string")),
                          F.try_variant_get(x, "$", "string"))

    flat = [*TSHARK_FIELDS, "timestamp", "protocol", *CHECKSUM_FIELDS]
    direct = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(f).alias("k"), F.try_variant_get(element, f"$['{f}']", "variant").alias("v")) for f in flat]),
        lambda e: e["v"].isNotNull()))
    nested = F.try_variant_get(element, "$._source.layers", "map<string,variant>")
    raw = files.json_elements(spark, path)
    return tshark_rows(pin(raw, {"_m": F.coalesce(nested, direct)}).select(F.transform_values("_m", first).alias("row")))


def tshark_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated field lines of a live capture; lines without time or addresses are skipped."""
    parts = F.split(F.regexp_replace(F.col(column), r"[\r\n]+$", ""), "\t", -1)
    names = F.array(*[F.lit(f) for f in TSHARK_FIELDS])
    n = F.least(F.size(parts), F.lit(len(TSHARK_FIELDS)))
    rows = pin(df, {"row": F.map_from_arrays(F.slice(names, 1, n), F.slice(parts, 1, n))})
    for name in ("frame.time_epoch", "ip.src", "ip.dst"):
        rows = rows.filter(F.coalesce(F.try_element_at("row", F.lit(name)), F.lit("")) != "")
    return tshark_rows(rows, source="tshark_live")


def read_tshark_fields(spark: SparkSession, path: str) -> DataFrame:
    return tshark_lines(spark.read.text(path))


def zeek_lines(df: DataFrame, fields: list[str] | None = None, column: str = "value", names: str | None = None) -> DataFrame:
    """Connection log lines to events. Bad numbers count as zero and port zero as none.

    Columns are named by ``fields``, or row by row by the array column ``names`` (null: the defaults).
    """
    fields = fields or ZEEK_FIELDS
    parts = F.split(F.regexp_replace(F.col(column), r"[\r\n]+$", ""), "\t", -1)
    known = F.array(*[F.lit(x) for x in fields])
    named = F.coalesce(names, known) if names else known
    lines = df.filter(~F.col(column).startswith("#") & (F.trim(column) != "")).select(parts.alias("p"), named.alias("names"))

    def get(name: str) -> Column:
        at = F.array_position("names", F.lit(name)).cast("int")
        return F.when(at > 0, F.try_element_at("p", F.greatest(at, F.lit(1))))

    def number(name: str) -> Column:
        x = F.trim(get(name)).try_cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 9e18), x).otherwise(F.lit(0.0))

    def whole(name: str) -> Column:
        return number(name).cast("bigint")

    doc = F.to_json(F.struct(
        F.coalesce(get("uid"), F.lit("")).alias("uid"), F.coalesce(get("service"), F.lit("")).alias("service"),
        number("duration").alias("duration"), whole("orig_bytes").alias("orig_bytes"),
        whole("resp_bytes").alias("resp_bytes")))
    none = lambda t: F.lit(None).cast(t)
    out = lines.select(
        _epoch(F.coalesce(get("ts"), F.lit("0"))).alias("timestamp"),
        F.coalesce(get("id.orig_h"), F.lit("0.0.0.0")).alias("src_ip"),
        F.coalesce(get("id.resp_h"), F.lit("0.0.0.0")).alias("dst_ip"),
        F.nullif(whole("id.orig_p"), F.lit(0)).cast("int").alias("src_port"),
        F.nullif(whole("id.resp_p"), F.lit(0)).cast("int").alias("dst_port"),
        F.coalesce(get("proto"), F.lit("unknown")).alias("protocol"),
        (whole("orig_bytes") + whole("resp_bytes")).alias("packet_len"),
        none("int").alias("ttl"), none("int").alias("ip_id"), none("int").alias("ip_flags"),
        none("string").alias("tcp_flags"), none("int").alias("dscp"), none("string").alias("payload_hex"),
        F.lit("zeek").alias("data_source"), none("string").alias("asset_id"), F.parse_json(doc).alias("metadata"))
    return with_event_id(with_event_time(out))


def read_zeek(spark: SparkSession, path: str) -> DataFrame:
    """Connection logs of a file or folder; every file is read by its own header line, or by the defaults."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    header = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t")
    heads = lines.filter(F.col("value").startswith("#fields")).groupBy("_file").agg(
        F.min(F.slice(header, 2, 10_000)).alias("names"))  # one row per file
    return zeek_lines(lines.join(heads, "_file", "left"), names="names")
