"""JSON events, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions.math import pin
from tapline.schema import TRAFFIC_COLUMNS, with_event_id, with_event_time

_INT = {"src_port": "int", "dst_port": "int", "packet_len": "bigint", "ttl": "int", "ip_id": "int",
        "ip_flags": "int", "dscp": "int"}
_TEXT = ["src_ip", "dst_ip", "protocol", "tcp_flags", "payload_hex", "data_source", "asset_id"]
# Defaults of absent fields; a field listed here may not be null when present.
_DEFAULTS = {"src_ip": "0.0.0.0", "dst_ip": "0.0.0.0", "protocol": "TCP", "packet_len": 0,
             "data_source": "live_capture"}
# Unix times beyond this many seconds are read as milliseconds.
_MILLIS_FROM = 2e10


def parse_events(df: DataFrame, column: str = "value") -> DataFrame:
    """Add `e`: one event struct per JSON text or bytes value, null when it is not a valid event.

    Numbers may be given as text; absent fields take their defaults.
    """
    df = pin(df, {"_v": F.try_parse_json(F.col(column).cast("string"))})
    v = F.col("_v")
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    kind = lambda n: F.coalesce(F.schema_of_variant(F.variant_get(v, f"$.{n}", "variant")), F.lit("ABSENT"))
    df = pin(df, {
        "_root": F.schema_of_variant(v),
        **{f"_t_{n}": text(n) for n in ["timestamp", *_INT, *_TEXT]},
        **{f"_k_{n}": kind(n) for n in ["timestamp", "packet_len", *_TEXT, "metadata"]},
    })
    ok = F.col("_root").startswith("OBJECT")
    fields: dict[str, Column] = {}

    number = F.col("_t_timestamp").try_cast("double")
    seconds = F.when(F.abs(number) > _MILLIS_FROM, number / 1000).otherwise(number)
    ts = F.coalesce(F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")), F.try_to_timestamp(F.col("_t_timestamp")))
    given = F.col("_k_timestamp") != "ABSENT"
    ok = ok & (~given | ts.isNotNull())
    fields["timestamp"] = F.when(given, ts).otherwise(F.current_timestamp())

    for name, typ in _INT.items():
        t = F.col(f"_t_{name}")
        x = F.when(t.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.trim(t).try_cast("decimal(20,1)").try_cast(typ))
        ok = ok & (t.isNull() | x.isNotNull())
        fields[name] = x
    absent = F.col("_k_packet_len") == "ABSENT"
    ok = ok & (absent | fields["packet_len"].isNotNull())
    fields["packet_len"] = F.when(absent, F.lit(_DEFAULTS["packet_len"])).otherwise(fields["packet_len"])
    for name in _TEXT:
        k = F.col(f"_k_{name}")
        allowed = ["ABSENT", "STRING"] if name in _DEFAULTS else ["ABSENT", "STRING", "VOID"]
        ok = ok & k.isin(allowed)
        fields[name] = F.when(k == "ABSENT", F.lit(_DEFAULTS.get(name)).cast("string")).otherwise(F.col(f"_t_{name}"))
    ok = ok & ((F.col("_k_metadata") == "ABSENT") | F.col("_k_metadata").startswith("OBJECT"))
    fields["metadata"] = F.coalesce(F.variant_get(v, "$.metadata", "variant"), F.parse_json(F.lit("{}")))
    event = F.struct(*[fields[n].alias(n) for n in TRAFFIC_COLUMNS])
    helpers = [c for c in df.columns if c.startswith(("_v", "_root", "_t_", "_k_"))]
    return pin(df, {"e": F.when(F.coalesce(ok, F.lit(False)), event)}).drop(*helpers)


def events_from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Typed events from a text column; blank, malformed and invalid lines are dropped."""
    parsed = parse_events(df.filter(F.trim(F.col(column).cast("string")) != ""), column)
    return with_event_id(with_event_time(parsed.filter("e IS NOT NULL").select("e.*")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return events_from_json(spark.read.text(path))


def stream_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return events_from_json(spark.readStream.text(path))


def indicator_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """One indicator per line; blank and comment lines dropped, duplicates removed."""
    return (df.filter(~F.col(column).startswith("#")).select(F.trim(column).alias("indicator"))
            .filter("indicator <> ''").distinct())


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    return indicator_lines(spark.read.text(path))
