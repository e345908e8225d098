"""Traffic derived from the supplied `events` table by integer arithmetic on its columns.

Every row of `events` becomes one traffic event, so work grows with the table. Blocks of 400
events cycle through polling, scan, sweep, beacon and mixed traffic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions import metadata as md

BASE_US = 1_704_067_200_000_000
STEP_US = 50_000
MODBUS_READ = "000100000006010300000002"
MODBUS_WRITE = "00010000000601050001ff00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table stored in fewer pieces than there are cores; larger ones stay put."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .parquet(sf_dir))


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def traffic(ev: DataFrame, jitter: bool = False) -> DataFrame:
    """The canonical traffic event view over an `events` frame, batch or streaming.

    ``jitter`` adds up to 40 ms per event, which keeps the order and makes arrival gaps uneven.
    """
    e = F.col("event_id")
    b, p = F.expr("event_id div 400"), e % 400
    k, u = b % 5, F.col("user_id") % 20
    ev = ev.withColumns({
        "_b": b, "_p": p, "_u": u, "_props": F.get_json_object("props", "$.k").cast("int"),
        "_kind": F.when((k == 3) & (p % 10 != 0), F.lit(0)).otherwise(k.cast("int")),
        "_flag6": _pick(p % 6, ["FPU", "", "FS", "R", "RA", "SA"]),
    })
    b, p, u, kind, flag6 = (F.col(c) for c in ("_b", "_p", "_u", "_kind", "_flag6"))
    udp = (kind == 4) & (p % 4 == 0)

    def by_kind(ot, scan, sweep, beacon, mixed) -> Column:
        return (F.when(kind == 0, ot).when(kind == 1, scan).when(kind == 2, sweep)
                .when(kind == 3, beacon).otherwise(mixed))

    def ip(prefix: str, last: Column) -> Column:
        return F.concat(F.lit(prefix), last.cast("string"))

    var_len = (F.lit(60) + F.floor("value")).cast("bigint")
    frame = F.when(p % 50 == 0, F.lit(MODBUS_WRITE)).otherwise(F.lit(MODBUS_READ))
    meta = F.concat(
        F.lit('{"k":'), F.col("_props").cast("string"),
        F.when(F.col("_props") == 0, F.lit(',"payload_altered":true')).otherwise(F.lit("")),
        F.when(F.col("_props") == 1, F.lit(',"spoofed":true')).otherwise(F.lit("")), F.lit("}"))
    ts_us = F.lit(BASE_US) + e * STEP_US
    if jitter:
        ts_us = ts_us + (F.col("user_id") * 7919) % 40_000
    return ev.select(
        "event_id",
        ts_us.alias("ts_us"),
        F.timestamp_micros(ts_us).alias("timestamp"),
        by_kind(ip("10.0.0.", u + 1), ip("203.0.113.", b % 250), ip("203.0.114.", b % 250),
                F.lit("10.0.0.55"),
                ip("10.0.3.", F.when(flag6.startswith("R"), F.lit(1)).otherwise(u))).alias("src_ip"),
        by_kind(F.lit("10.0.0.100"), F.lit("10.0.1.1"), ip("10.0.2.", p % 200),
                F.lit("198.51.100.4"), ip("10.0.0.", p % 5)).alias("dst_ip"),
        by_kind(u + 40000, p + 50000, p + 50000, F.lit(55000), p + 40000).cast("int").alias("src_port"),
        by_kind(F.lit(502), p + 20, F.lit(445), F.lit(4444),
                _pick(p % 8, [53, 80, 443, 23, 22, 3389, 8080, 19001])).cast("int").alias("dst_port"),
        F.when(udp, F.lit("UDP")).otherwise(F.lit("TCP")).alias("protocol"),
        by_kind(F.lit("PA"), F.lit("S"), F.lit("S"), F.lit("PA"), F.when(~udp, flag6)).alias("tcp_flags"),
        by_kind(var_len, F.lit(64), F.lit(64), F.lit(128), var_len).cast("bigint").alias("packet_len"),
        by_kind(F.lit(64), F.lit(64), F.lit(64), F.lit(64), p % 5 + 32).cast("int").alias("ttl"),
        (e % 257).cast("int").alias("ip_id"),
        F.when(e % 3 > 0, F.lit(2)).otherwise(F.lit(0)).alias("ip_flags"),
        (F.col("user_id") % 4 * 8).cast("int").alias("dscp"),
        F.when(kind == 0, frame).alias("payload_hex"),
        F.lit("events_table").alias("data_source"),
        ip("asset-", F.col("user_id") % 10).alias("asset_id"),
        F.parse_json(meta).alias("metadata"),
    )


def batch_traffic(spark: SparkSession, sf_dir: str, jitter: bool = False) -> DataFrame:
    return traffic(events(spark, sf_dir), jitter)


def flagged(df: DataFrame) -> DataFrame:
    """Reduce the metadata document to the two booleans the window features need."""
    return df.withColumns({
        "altered": md.altered(F.col("metadata")),
        "spoofed": md.spoofed(F.col("metadata"), F.col("src_ip")),
    })


def conversations_traffic(ev: DataFrame) -> DataFrame:
    """Two-way traffic between few endpoints, with idle gaps and long sessions, for flow tests."""
    e, user = F.col("event_id"), F.col("user_id")
    reply = F.expr("(event_id div 3) % 2 = 1")
    a_ip = F.concat(F.lit("10.9.0."), (user % 120).cast("string"))
    b_ip = F.concat(F.lit("10.9.1."), (user % 3).cast("string"))
    a_port, b_port = (user % 5 + 40000).cast("int"), F.lit(443)
    ts_us = F.lit(BASE_US) + e * 400_000 + (user * 7919) % 300_000
    udp = user % 11 == 0
    return ev.select(
        "event_id", ts_us.alias("ts_us"), F.timestamp_micros(ts_us).alias("timestamp"),
        F.when(reply, b_ip).otherwise(a_ip).alias("src_ip"),
        F.when(reply, a_ip).otherwise(b_ip).alias("dst_ip"),
        F.when(reply, b_port).otherwise(a_port).alias("src_port"),
        F.when(reply, a_port).otherwise(b_port).alias("dst_port"),
        F.when(udp, F.lit("UDP")).otherwise(F.lit("TCP")).alias("protocol"),
        F.when(~udp, _pick(e % 17, ["S", "SA", "A", "PA", "A", "PA", "FA", "A", "S", "SA", "A", "",
                                    "PA", "A", "PA", "A", "R"])).alias("tcp_flags"),
        (F.lit(60) + F.floor("value")).cast("bigint").alias("packet_len"),
        F.when(e % 4 == 0, F.col("event_type")).alias("app_protocol"),
        F.when(e % 9 == 0, F.concat(F.lit("host-"), (user % 7).cast("string"))).alias("tls_sni"),
        F.when(e % 10 == 0, F.lit("")).when(e % 5 == 0, F.concat(F.lit("q"), (e % 13).cast("string")))
        .alias("dns_query"),
    )


def ioc_seed(spark: SparkSession) -> DataFrame:
    """Literal indicator rows: an exit node, an abuse score, and a private address to ignore."""
    return spark.createDataFrame(
        [("203.0.113.1", "exit", None, None), ("198.51.100.4", "abuse", 72, 9), ("10.0.0.55", "exit", None, None)],
        "indicator string, kind string, abuse_score int, reports int")


def arriving(df: DataFrame, path: str, parts: int = 4, late_us: int = 0, files: int = 4) -> DataFrame:
    """The rows as a stream of ``parts`` micro-batches, each up to ``late_us`` out of event-time order.

    The rows are written in order of arrival, a micro-batch as ``files`` files.
    """
    spark = df.sparkSession
    at = F.col("ts_us") + (F.pmod(F.xxhash64("event_id"), F.lit(late_us)) if late_us else F.lit(0))
    rows = df.withColumn("_at", at)
    share = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = rows.agg(F.percentile_approx("_at", share, F.lit(1000)).alias("q")).first().q or []
    edges = [-(1 << 62), *cuts, 1 << 62]
    for low, high in zip(edges, edges[1:]):
        part = rows.filter((F.col("_at") > low) & (F.col("_at") <= high)).drop("_at")
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
