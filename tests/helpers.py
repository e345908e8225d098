"""Literal traffic frames and result comparison."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

T0 = 1_704_067_200_000_000
SCHEMA = ("event_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
          "packet_len long, ttl int, ip_id int, ip_flags int, tcp_flags string, dscp int, payload_hex string, meta string")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def traffic(spark, rows, **defaults):
    """Frame of events given as dicts with ``at`` in seconds."""
    base = {"src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": None, "dst_port": None, "protocol": "TCP",
            "packet_len": 100, "ttl": None, "ip_id": None, "ip_flags": None, "tcp_flags": None, "dscp": None,
            "payload_hex": None, "meta": "{}", **defaults}
    data = []
    for i, r in enumerate(rows):
        full = {**base, **r}
        full["event_id"], full["ts_us"] = i, T0 + round(full.pop("at") * 1e6)
        data.append(tuple(full[n] for n in NAMES))
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumns({"timestamp": F.timestamp_micros("ts_us"), "metadata": F.parse_json("meta")}).drop("meta")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
