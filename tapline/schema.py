"""Column contracts shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_JSON = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("packet_len", T.LongType()),
    T.StructField("ttl", T.IntegerType()),
    T.StructField("ip_id", T.IntegerType()),
    T.StructField("ip_flags", T.IntegerType()),
    T.StructField("tcp_flags", T.StringType()),
    T.StructField("dscp", T.IntegerType()),
    T.StructField("payload_hex", T.StringType()),
    T.StructField("data_source", T.StringType()),
    T.StructField("asset_id", T.StringType()),
    T.StructField("metadata", T.VariantType()),
])

TRAFFIC_COLUMNS = [f.name for f in EVENT_JSON.fields]

# Identity for duplicate elimination; ports are not part of it.
DEDUP_KEY = ["ts_us", "src_ip", "dst_ip", "protocol", "packet_len"]

SIGNAL_COLUMNS = [
    "category", "detection_method", "severity", "src_ip", "dst_ip", "src_port", "dst_port",
    "protocol", "evidence", "score", "ts_us", "event_id", "seq",
]

RISK_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
FEEDBACK_LABELS = ["TRUE_POSITIVE", "FALSE_POSITIVE", "BENIGN", "UNKNOWN"]


def with_event_time(df: DataFrame) -> DataFrame:
    """Add the integer time every operator computes with."""
    return df.withColumn("ts_us", F.unix_micros(F.col("timestamp").cast("timestamp")))


def with_event_id(df: DataFrame) -> DataFrame:
    """Add a content-derived tie-break for sources that carry no sequence number.

    A row-position id would change when a lost task is recomputed; a hash of the row does not.
    """
    cols = [c for c in TRAFFIC_COLUMNS if c in df.columns and c != "metadata"]
    return df.withColumn("event_id", F.xxhash64(*cols))


def port(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0))
