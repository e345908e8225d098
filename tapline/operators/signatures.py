"""Packet signatures: one row in, zero to six signals out, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.config import DEFAULT, Config
from tapline.operators import behaviors
from tapline.schema import SIGNAL_COLUMNS, port

METHOD = "Signature Detection"


@dataclass(frozen=True)
class Rule:
    """A signature. ``predicate`` and ``evidence`` are SQL over the columns `prepare` adds."""

    rule_id: str
    name: str
    description: str
    severity: str
    category: str
    mitre_technique: str
    predicate: str | None
    evidence: str | None = None
    version: str = "1.0.0"
    enabled: bool = True


# The rule catalogue. SIG-DOS-001 is listed without a packet predicate; see syn_floods.
CATALOGUE = [
    Rule("SIG-SCAN-001", "TCP Xmas Scan Detected",
         "Packet observed with FIN, PSH, and URG flags set simultaneously (RFC 793 violation).",
         "HIGH", "RECONNAISSANCE", "T1046",
         "proto = 'TCP' AND contains(flags, 'F') AND contains(flags, 'P') AND contains(flags, 'U')",
         "concat('TCP flags: ', flags)"),
    Rule("SIG-SCAN-002", "TCP Null Scan Detected",
         "TCP packet observed with zero flags set, indicating active OS fingerprinting probe.",
         "MEDIUM", "RECONNAISSANCE", "T1046",
         "proto = 'TCP' AND flags = '' AND flags_known AND packet_len > 0",
         "'TCP packet has zero flags'"),
    Rule("SIG-SCAN-003", "TCP SYN-FIN Scan Probe",
         "TCP packet with illegal SYN and FIN flags set simultaneously.",
         "HIGH", "RECONNAISSANCE", "T1046",
         "proto = 'TCP' AND contains(flags, 'S') AND contains(flags, 'F')",
         "concat('Illegal TCP flag combination: ', flags)"),
    Rule("SIG-DOS-001", "TCP SYN-Flood Pattern",
         "High-frequency TCP connection request with SYN flag without ACK completion.",
         "HIGH", "DENIAL_OF_SERVICE", "T1498", None),
    Rule("SIG-OT-001", "Unauthorized Modbus Coil Modification",
         "Modbus TCP command attempting Write Single Coil (0x05) or Write Multiple (0x0F).",
         "CRITICAL", "OT_INTEGRITY_VIOLATION", "T0855",
         "(dport = 502 OR sport = 502) AND length(payload) >= 16 AND upper(substring(payload, 15, 2)) "
         "IN ('05', '06', '0F', '10')",
         "concat('Modbus Write Function Code 0x', upper(substring(payload, 15, 2)))"),
    Rule("SIG-OT-002", "Industrial Protocol Stop Command (S7comm)",
         "Industrial PLC stop execution request detected on port 102.",
         "CRITICAL", "OT_INTEGRITY_VIOLATION", "T0816",
         "(dport = 102 OR sport = 102) AND (contains(lower(payload), '29000000000009') "
         "OR contains(lower(payload), 'stop'))",
         "'S7comm Stop CPU command sequence'"),
    Rule("SIG-NET-001", "Cleartext Telnet Administration Detected",
         "Insecure remote administration connection attempted on port 23.",
         "MEDIUM", "INSECURE_PROTOCOL", "T1021",
         "dport = 23 OR sport = 23",
         "concat('Cleartext telnet connection ', src_ip, ' -> ', dst_ip, ':23')"),
]


def catalogue(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rule listing as a table; its size is the number of rules."""
    return spark.createDataFrame(
        [(r.rule_id, r.name, r.description, r.severity, r.category, r.version, r.enabled, r.mitre_technique)
         for r in rules or CATALOGUE],
        "rule_id string, name string, description string, severity string, category string, "
        "version string, enabled boolean, mitre_technique string")


def prepare(df: DataFrame, null_is_zero_flags: bool = True) -> DataFrame:
    known = F.lit(True) if null_is_zero_flags else F.col("tcp_flags").isNotNull()
    return df.withColumns({
        "proto": F.upper("protocol"), "flags": F.coalesce("tcp_flags", F.lit("")), "flags_known": known,
        "dport": port("dst_port"), "sport": port("src_port"),
        "payload": F.coalesce("payload_hex", F.lit("")),
    })


def matches(df: DataFrame, rules: list[Rule] | None = None, null_is_zero_flags: bool = True) -> DataFrame:
    """One row per (event, matching enabled rule), with the rule's metadata.

    Missing TCP flags count as zero flags unless ``null_is_zero_flags`` is off.
    """
    active = [r for r in rules or CATALOGUE if r.enabled and r.predicate]
    hits = []
    for seq, r in enumerate(active):
        hits.append(F.when(F.expr(r.predicate), F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"),
            F.lit(r.version).alias("rule_version"), F.lit(r.severity).alias("severity"),
            F.lit(r.category).alias("category"), F.lit(r.mitre_technique).alias("mitre_technique"),
            F.expr(r.evidence).alias("evidence"), F.lit(seq).alias("seq"))))
    keep = ["event_id", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    found = prepare(df, null_is_zero_flags).select(
        *keep, F.explode(F.filter(F.array(*hits), lambda m: m.isNotNull())).alias("_m"))
    return found.select(*keep, "_m.*")


def signature_signals(df: DataFrame, rules: list[Rule] | None = None, null_is_zero_flags: bool = True) -> DataFrame:
    m = matches(df, rules, null_is_zero_flags)
    return m.withColumns({
        "detection_method": F.lit(METHOD),
        "evidence": F.concat(F.lit("Rule "), "rule_id", F.lit(" ("), "rule_name", F.lit("): "), "evidence"),
        "score": F.when(F.col("severity").isin("CRITICAL", "HIGH"), F.lit(0.90)).otherwise(F.lit(0.60)),
    }).select(*SIGNAL_COLUMNS)


def rule_hits(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Hits per catalogue rule, rules without a hit included: the catalogue joined by key.

    The catalogue is broadcast: it has one row per rule.
    """
    spark = df.sparkSession
    counted = matches(df, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return (F.broadcast(catalogue(spark, rules)).join(counted, "rule_id", "left")
            .withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint"))))


def syn_floods(df: DataFrame, threshold: int = 100, window_us: int = 1_000_000,
               cfg: Config = DEFAULT) -> DataFrame:
    """Opt-in evaluation of SIG-DOS-001: connection requests without ACK per destination.

    Runs the same entry/expiry sum as the behaviour rules with the destination as the entity.
    """
    syn = df.filter((F.upper("protocol") == "TCP") & F.col("tcp_flags").contains("S")
                    & ~F.col("tcp_flags").contains("A"))
    as_entity = syn.withColumns({"src_ip": F.col("dst_ip"), "tcp_flags": F.lit("R")})
    narrowed = Config(**{**cfg.__dict__, "rst_storm_us": window_us, "rst_storm_count": threshold})
    counted = behaviors.behaviour_counts(as_entity, narrowed, ("rst",))
    rule = next(r for r in CATALOGUE if r.rule_id == "SIG-DOS-001")
    return counted.filter(F.col("rst_count") >= threshold).select(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.category).alias("category"),
        F.lit(rule.severity).alias("severity"), "dst_ip", F.col("rst_count").alias("syn_count"),
        "ts_us", "event_id")
