"""Sliding windows on a stream: the slot and value aggregates of the batch operators, watermarked.

Rows later than the watermark are dropped. A window is emitted once, complete, when the watermark
passes its end; the grid and the (end - size, end] membership are those of the batch operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.operators import windows


def _us(n: int) -> str:
    return f"{n} microseconds"


def lateness(cfg: Config) -> str:
    """Events are kept for one window and one slide behind the newest."""
    return _us(cfg.window_us + cfg.slide_us)


def sliding(cfg: Config) -> Column:
    """Half-open Spark windows moved by one microsecond become (end - size, end]."""
    return F.window("timestamp", _us(cfg.window_us), _us(cfg.slide_us), _us(cfg.origin_us % cfg.slide_us + 1))


def window_end() -> Column:
    return (F.unix_micros(F.col("window.end")) - 1).alias("window_end")


def watermarked(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return df.withWatermark("timestamp", lateness(cfg))


def dedup(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Duplicate elimination with state bounded by the watermark."""
    return watermarked(df, cfg).dropDuplicatesWithinWatermark(
        ["timestamp", "src_ip", "dst_ip", "protocol", "packet_len"])


def volumes(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Additive window measures."""
    n = F.count(F.lit(1))
    out = watermarked(df, cfg).groupBy(sliding(cfg)).agg(
        n.alias("packets"), F.sum("packet_len").alias("bytes"),
        F.unix_micros(F.min("timestamp")).alias("first_us"), F.unix_micros(F.max("timestamp")).alias("last_us"),
        F.avg("packet_len").alias("packet_len_mean"), F.stddev_pop("packet_len").alias("packet_len_std"),
        F.avg(F.when(F.upper("protocol") == "UDP", 1.0).otherwise(0.0)).alias("udp_ratio"))
    duration = F.greatest((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(1.0))
    return out.select(window_end(), "packets", "bytes", (F.col("packets") / duration).alias("packets_per_sec"),
                      (F.col("bytes") / duration).alias("bytes_per_sec"), "packet_len_mean", "packet_len_std",
                      "udp_ratio")


def value_features(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Distinct counts and entropies through two chained aggregations, so state holds one counter
    per (window, field, value) instead of sets."""
    fields = {"dport": F.col("dst_port").cast("string"), "dst": F.col("dst_ip"), "src": F.col("src_ip"),
              "tcp_flags": F.nullif("tcp_flags", F.lit(""))}
    long = watermarked(df, cfg).select("timestamp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()])).alias("e")
    ).select("timestamp", "e.*").filter("value IS NOT NULL")
    counted = long.groupBy(sliding(cfg), "field", "value").agg(F.count(F.lit(1)).alias("n"))
    is_ = lambda f: F.col("field") == f
    out = counted.groupBy("window").agg(
        F.count_if(is_("dport")).alias("port_diversity"), F.count_if(is_("dst")).alias("destination_diversity"),
        F.count_if(is_("src")).alias("source_diversity"),
        windows.entropy_bits(F.col("n"), is_("tcp_flags")).alias("tcp_flags_entropy"))
    return out.select(window_end(), "port_diversity", "destination_diversity", "source_diversity", "tcp_flags_entropy")
