"""Indicator and reputation lookups as joins.

Feed tables are broadcast only after their size has been measured. Beyond the limit the lookup is
an ordinary equi-join on the address, with the distinct addresses of the traffic joined first so
that a frequent address crosses the network once per map task instead of once per packet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.schema import SIGNAL_COLUMNS

METHOD = "Threat Intelligence"

# Addresses that never reach a feed. 172.16/12 is deliberately absent.
LOCAL_ADDRESSES = ["127.0.0.1", "0.0.0.0", "::1"]
LOCAL_PREFIXES = ["10.", "192.168."]

BROADCAST_ROWS = 500_000


def is_local(ip: Column) -> Column:
    out = ip.isNull() | (ip == "") | ip.isin(LOCAL_ADDRESSES)
    for prefix in LOCAL_PREFIXES:
        out = out | ip.startswith(prefix)
    return out


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Count at most ``limit + 1`` rows of a feed to decide whether it may be broadcast."""
    return table.limit(limit + 1).count() <= limit


def reputation(exit_nodes: DataFrame, abuse: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One verdict row per listed indicator; an exit-node listing outranks an abuse score.

    ``exit_nodes(indicator)``, ``abuse(indicator, abuse_score, reports)``.
    """
    exits = exit_nodes.select(
        "indicator", F.lit(0).alias("_rank"), F.lit(True).alias("is_malicious"),
        F.lit(0.85).alias("reputation_score"), F.lit("TorProject-ExitDirectory").alias("source"),
        F.lit("Active Tor Exit Node").alias("attribution"))
    scored = abuse.select(
        "indicator", F.lit(1).alias("_rank"), (F.col("abuse_score") >= cfg.abuse_min_score).alias("is_malicious"),
        F.round(F.col("abuse_score") / 100.0, 2).alias("reputation_score"), F.lit("AbuseIPDB").alias("source"),
        F.format_string("AbuseIPDB Score %d%% (%d reports)", "abuse_score", F.coalesce("reports", F.lit(0)))
        .alias("attribution"))
    both = exits.unionByName(scored)
    fields = ["is_malicious", "reputation_score", "source", "attribution"]
    return (both.groupBy("indicator")
            .agg(F.min_by(F.struct(*fields), F.struct("_rank", F.lit(0) - F.col("reputation_score"))).alias("v"))
            .select("indicator", *[F.col(f"v.{f}").alias(f) for f in fields]))


def check_ip(df: DataFrame, ip_col: str, verdicts: DataFrame, small: bool | None = None) -> DataFrame:
    """Left lookup of an address column. Unlisted and local addresses get their fixed answers."""
    small = fits_broadcast(verdicts) if small is None else small
    v = verdicts.select(F.col("indicator").alias("_ind"), "is_malicious", "reputation_score", "source", "attribution")
    local = is_local(F.col(ip_col))
    key = F.when(~local, F.col(ip_col))  # null keys never match and need no shuffle target
    if small:
        joined = df.join(F.broadcast(v), key == F.col("_ind"), "left").drop("_ind")
    else:
        addresses = df.select(key.alias("_ip")).filter("_ip IS NOT NULL").distinct()
        hits = addresses.join(v, F.col("_ip") == F.col("_ind")).drop("_ind")
        # Address-level hits of a large feed are still spread over their keys; AQE splits a hot one.
        joined = df.join(hits, key == F.col("_ip"), "left").drop("_ip")
    return joined.withColumns({
        "is_malicious": F.coalesce("is_malicious", F.lit(False)),
        "reputation_score": F.coalesce("reputation_score", F.lit(0.0)),
        "source": F.coalesce("source", F.when(local, F.lit("LocalSubnetFilter"))
                             .otherwise(F.lit("LiveThreatIntelFeeds"))),
        "attribution": F.coalesce("attribution", F.when(local, F.lit("Private / Local Loopback IP"))
                                  .otherwise(F.lit("Not listed on active threat feeds"))),
    })


def intel_signals(df: DataFrame, verdicts: DataFrame, small: bool | None = None) -> DataFrame:
    """Signals for traffic whose source is listed as malicious (inner variant of the lookup)."""
    small = fits_broadcast(verdicts) if small is None else small
    bad = verdicts.filter("is_malicious").select(
        F.col("indicator").alias("_ind"), "reputation_score", "source", "attribution")
    rows = df.filter(~is_local(F.col("src_ip")))
    joined = rows.join(F.broadcast(bad) if small else bad, F.col("src_ip") == F.col("_ind"))
    return joined.withColumns({
        "detection_method": F.lit(METHOD), "category": F.lit("KNOWN_MALICIOUS_INFRASTRUCTURE"),
        "severity": F.when(F.col("reputation_score") >= 0.8, F.lit("CRITICAL")).otherwise(F.lit("HIGH")),
        "evidence": F.concat(F.lit("Threat Intelligence Match via "), "source", F.lit(": "), "attribution"),
        "score": F.col("reputation_score"), "seq": F.lit(20),
    }).select(*SIGNAL_COLUMNS)


def ioc_lookup(df: DataFrame, ip_col: str, store: DataFrame, small: bool | None = None) -> DataFrame:
    """Exact lookup in a local indicator store, ``match`` false by default."""
    small = fits_broadcast(store) if small is None else small
    s = store.select(F.col("indicator").alias("_ind")).distinct()
    joined = df.join(F.broadcast(s) if small else s, F.col(ip_col) == F.col("_ind"), "left")
    return joined.withColumn("match", F.col("_ind").isNotNull()).drop("_ind")


def enrich_endpoints(df: DataFrame, verdicts: DataFrame, small: bool | None = None) -> DataFrame:
    """Add ``threat_intel``: the first malicious endpoint of (source, destination), else clean."""
    small = fits_broadcast(verdicts) if small is None else small
    out = df
    for side in ("src", "dst"):
        v = verdicts.filter("is_malicious").select(
            F.col("indicator").alias(f"_{side}"),
            F.struct(F.col("indicator").alias("ip"), "reputation_score", "source", "attribution").alias(f"_{side}_hit"))
        key = F.when(~is_local(F.col(f"{side}_ip")), F.col(f"{side}_ip"))
        out = out.join(F.broadcast(v) if small else v, key == F.col(f"_{side}"), "left").drop(f"_{side}")
    hit = F.coalesce("_src_hit", "_dst_hit")
    return out.withColumn("threat_intel", F.struct(
        F.when(hit.isNotNull(), F.lit("match")).otherwise(F.lit("clean")).alias("status"),
        hit["ip"].alias("ip"), hit["reputation_score"].alias("reputation_score"),
        hit["source"].alias("source"), hit["attribution"].alias("attribution"))).drop("_src_hit", "_dst_hit")


def verdict_versions(lookups: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Validity interval of each recorded lookup ``(indicator, looked_up_us, is_malicious, ...)``.

    A hit is valid for a day, a clean answer for at most an hour, and either ends early when a newer
    lookup of the same indicator exists.
    """
    from pyspark.sql import Window

    ttl = F.when(F.col("is_malicious"), F.lit(cfg.intel_hit_ttl_us)).otherwise(
        F.lit(min(cfg.intel_hit_ttl_us, cfg.intel_clean_ttl_us)))
    w = Window.partitionBy("indicator").orderBy("looked_up_us")
    end = F.col("looked_up_us") + ttl
    return lookups.withColumns({
        "valid_from": F.col("looked_up_us"),
        "valid_to": F.least(end, F.coalesce(F.lead("looked_up_us").over(w), end)),
    }).drop("looked_up_us")


def check_ip_as_of(df: DataFrame, ip_col: str, versions: DataFrame, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Interval lookup: the verdict whose validity covers the event's time, if any.

    The interval is cut into hour buckets, so the join is an equi-join on (address, bucket) and a
    hot address is spread over its hours.
    """
    first = F.floor(F.col("valid_from") / bucket_us)
    last = F.floor((F.col("valid_to") - 1) / bucket_us)
    v = (versions.filter("valid_to > valid_from")
         .withColumn("_vb", F.explode(F.sequence(first, last)))
         .withColumnRenamed("indicator", "_ind"))
    e = df.withColumn("_eb", F.floor(F.col("ts_us") / bucket_us))
    cond = ((F.col(ip_col) == F.col("_ind")) & (F.col("_eb") == F.col("_vb"))
            & (F.col("ts_us") >= F.col("valid_from")) & (F.col("ts_us") < F.col("valid_to")))
    return e.join(v, cond, "left").drop("_ind", "_vb", "_eb")
