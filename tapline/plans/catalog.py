"""Registered queries: every operator over the whole supplied tables.

Each entry takes (spark, folder) and returns a DataFrame. Results are normalised for comparison:
doubles to six places, integers to BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapline.config import Config
from tapline.functions import metadata as md
from tapline.functions import protocol as pr
from tapline.functions import tls
from tapline.operators import (
    baseline, behaviors, correlate, explain, extractor, features, flows, integrity, intel, metrics, models,
    persistence, reporting, scoring, signatures, splits,
)
from tapline.plans import detection, training, window_alerts
from tapline.session import materialise, scratch, tasks_for
from tapline.sources import captures, labelled, sinks, tables
from tapline.sources import events as ev_src
from tapline.sources.keyed import KeyedTable
from tapline.streaming import alerts as stream_alerts
from tapline.streaming import detect, publish, run
from tapline.streaming import flows as stream_flows
from tapline.streaming import incidents as stream_incidents
from tapline.streaming import windows as stream_windows
from tapline.streaming.state import State

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.round(c, 6) + F.lit(0.0)
        elif kind in ("integer", "short", "byte", "long"):
            c = c.cast("bigint")
        elif kind == "decimal":
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf: normalise(fn(spark, sf))
    return fn


# --- shared inputs ----------------------------------------------------------------------------


def _traffic(spark: SparkSession, sf: str) -> DataFrame:
    return tables.batch_traffic(spark, sf)


def _uneven(spark: SparkSession, sf: str) -> DataFrame:
    return tables.flagged(tables.batch_traffic(spark, sf, jitter=True))


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    return tables.conversations_traffic(tables.events(spark, sf))


def _verdicts(spark: SparkSession) -> DataFrame:
    seed = tables.ioc_seed(spark)
    return intel.reputation(seed.filter("kind = 'exit'"), seed.filter("kind = 'abuse'"))


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return detection.alerts(_traffic(spark, sf), _verdicts(spark))


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    return window_alerts.assessed_windows(_uneven(spark, sf))


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Embedding components as features; the two lowest labels form the positive class."""
    cols = [f"f{i}" for i in range(64)]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").cast("bigint").alias("row_id"), (F.col("label") < 2).cast("int").alias("label"),
        *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(cols)])
    return rows, cols


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a label, scored by their length; many share a score."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    return lab.join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("label"),
        F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 2).alias("score"))


def _pick(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in cols])


# --- sources ----------------------------------------------------------------------------------


@query
def tshark_export(spark, sf):
    """An analyser export, one indented JSON array with nested layers, read by several tasks."""
    t = _traffic(spark, sf)
    status = F.when(F.col("event_id") % 40 == 0, F.lit("Bad")).otherwise(F.lit("Good"))
    layers = F.struct(*[F.array(v.cast("string")).alias(n) for n, v in (
        ("frame.time_epoch", (F.col("ts_us") / 1e6).cast("decimal(20,6)")), ("ip.src", F.col("src_ip")), ("ip.dst", F.col("dst_ip")),
        ("frame.len", F.col("packet_len")), ("ip.checksum.status", status), ("tcp.payload", F.lit('a "]}{[" \\')))])
    doc = F.to_json(F.struct(F.struct(layers.alias("layers")).alias("_source")), {"pretty": "true"})
    path = scratch(spark, "export")
    rows = t.select("event_id", F.concat(F.when(F.col("event_id") == 0, F.lit("[\n")).otherwise(F.lit(",\n")), doc).alias("value"))
    end = spark.range(1).select(F.lit((1 << 62)).alias("event_id"), F.lit("]").alias("value"))
    rows = rows.unionByName(end)
    # sorted by many tasks and stored, so that the one task that writes the file only passes the lines on
    rows = rows.repartitionByRange(tasks_for(rows), "event_id").sortWithinPartitions("event_id").select("value").persist(StorageLevel.DISK_ONLY)
    rows.count()
    rows.coalesce(1).write.text(path)
    rows.unpersist()
    out = captures.read_tshark_json(spark, path)
    return out.groupBy("src_ip", "protocol", md.altered(F.col("metadata")).alias("altered")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("packet_len").alias("bytes"), F.max("ts_us").alias("last_us"))


@query
def dataset_checksums(spark, sf):
    """SHA-256 of CSV files, one per nation, as the dataset contract checks them."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    path = scratch(spark, "checksums")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    (c.select(F.col("c_nationkey").cast("int").alias("nation"), "c_custkey", line.alias("value")).repartition("nation")
     .sortWithinPartitions("nation", "c_custkey").select("nation", "value").write.partitionBy("nation").text(path))
    return labelled.checksums(spark, path).select(
        F.regexp_extract("path", r"nation=(\d+)/", 1).cast("bigint").alias("nation"), F.col("bytes"), "sha256")


@query
def traffic_view(spark, sf):
    return _traffic(spark, sf).drop("metadata", "timestamp")


@query
def jsonl_events(spark, sf):
    """Events written as JSON lines, some damaged, and read back."""
    t = _traffic(spark, sf)
    doc = F.to_json(F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "src_ip", "dst_ip", "src_port",
        F.col("dst_port").cast("string").alias("dst_port"), "protocol", "packet_len", "ttl", "ip_id", "tcp_flags",
        "payload_hex"))
    e = F.col("event_id")
    line = (F.when(e % 50 == 0, F.lit("")).when(e % 50 == 1, F.lit("{broken")).when(e % 50 == 2, F.lit("[1]"))
            .when(e % 50 == 3, F.regexp_replace(doc, '"packet_len":[0-9]+', '"packet_len":"x"')).otherwise(doc))
    return ev_src.events_from_json(t.select(line.alias("value"))).groupBy(
        "src_ip", "dst_port", "protocol", "data_source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("packet_len").alias("bytes"), F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"))


@query
def tshark_fields(spark, sf):
    """Tab-separated capture lines; lines without an address are skipped."""
    t = _traffic(spark, sf)
    tcp = F.col("protocol") == "TCP"
    num = lambda c: F.col(c).cast("string")
    blank = F.lit("")
    line = F.concat_ws(
        "\t", F.concat(F.expr("ts_us div 1000000").cast("string"), F.lit("."), F.lpad((F.col("ts_us") % 1_000_000)
                       .cast("string"), 6, "0")),
        F.when(F.col("event_id") % 20 == 0, blank).otherwise(F.col("src_ip")), "dst_ip",
        F.when(tcp, num("src_port")).otherwise(blank), F.when(tcp, num("dst_port")).otherwise(blank),
        F.when(tcp, blank).otherwise(num("src_port")), F.when(tcp, blank).otherwise(num("dst_port")),
        "protocol", num("packet_len"), num("ttl"), F.when(F.col("event_id") % 3 == 0, F.lit("0x1f")).otherwise(num("ip_id")),
        blank, blank)
    out = captures.tshark_lines(t.select(line.alias("value")))
    return out.groupBy("src_ip", "protocol", "data_source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("packet_len").alias("bytes"), F.sum("dst_port").alias("ports"),
        F.count("ip_id").alias("ids"), F.sum(F.col("ts_us").cast("decimal(38,0)")).cast("string").alias("times"))  # past 64 bits


@query
def tshark_rows(spark, sf):
    """Analyser rows: payload keys dropped, failed checksums noted as alteration evidence."""
    t = _traffic(spark, sf)
    status = F.when(F.col("event_id") % 40 == 0, F.lit("Bad")).otherwise(F.lit("Good"))
    row = F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("frame.time_epoch", "ip.src", "ip.dst", "frame.len", "ip.checksum.status",
                                     "tcp.payload", "frame.data.data")]),
        F.array((F.col("ts_us") / 1e6).cast("decimal(20,6)").cast("string"), F.col("src_ip"), F.col("dst_ip"),
                F.col("packet_len").cast("string"), status, F.lit("secret"), F.lit("secret")))
    out = captures.tshark_rows(t.select(row.alias("row")))
    m = F.col("metadata")
    return out.groupBy("src_ip", "protocol", md.altered(m).alias("altered"),
                       F.variant_get(m, "$['tcp.payload']", "string").isNotNull().alias("leaked")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("packet_len").alias("bytes"), F.max("ts_us").alias("last_us"))


@query
def zeek_conn(spark, sf):
    """Connection log lines with a reordered header, bad numbers and comments."""
    t = _traffic(spark, sf)
    e = F.col("event_id")
    line = F.when(e % 100 == 0, F.lit("#comment")).otherwise(F.concat_ws(
        "\t", (F.col("ts_us") / 1e6).cast("decimal(20,6)").cast("string"), "src_ip",
        F.when(e % 9 == 0, F.lit("0")).otherwise(F.col("src_port").cast("string")), "dst_ip",
        F.col("dst_port").cast("string"), F.lower("protocol"),
        F.when(e % 11 == 0, F.lit("-")).otherwise(F.col("packet_len").cast("string")), (e % 7).cast("string")))
    out = captures.zeek_lines(t.select(line.alias("value")), [
        "ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "orig_bytes", "resp_bytes"])
    return out.groupBy("src_ip", "dst_ip", "protocol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("packet_len").alias("bytes"), F.count("src_port").alias("ports"),
        F.sum(F.variant_get("metadata", "$.resp_bytes", "bigint")).alias("resp_bytes"), F.min("ts_us").alias("first_us"))


@query
def zeek_folder(spark, sf):
    """A folder of connection logs with two different headers, one without uid and in another order, row by row."""
    t = _traffic(spark, sf)
    e = F.col("event_id")
    cell = {"ts": (F.col("ts_us") / 1e6).cast("decimal(20,6)").cast("string"), "uid": F.concat(F.lit("C"), e.cast("string")),
            "id.orig_h": F.col("src_ip"), "id.orig_p": F.col("src_port").cast("string"), "id.resp_h": F.col("dst_ip"),
            "id.resp_p": F.col("dst_port").cast("string"), "proto": F.lower("protocol"),
            "orig_bytes": F.col("packet_len").cast("string"), "resp_bytes": (e % 7).cast("string")}
    folder = scratch(spark, "zeek")
    for k, names in enumerate((list(cell), ["proto", "id.resp_p", "id.resp_h", "id.orig_p", "id.orig_h", "resp_bytes", "orig_bytes", "ts"])):
        lines = t.filter(e % 2 == k).select(F.pmod(e, F.lit(4)).alias("k"), F.lit(1).alias("o"), F.concat_ws(
            "\t", *[F.coalesce(cell[n], F.lit("-")) for n in names]).alias("value"))
        heads = spark.range(4).select(F.col("id").alias("k"), F.lit(0).alias("o"), F.lit("#fields\t" + "\t".join(names)).alias("value"))
        lines.unionByName(heads).repartitionByRange(4, "k").sortWithinPartitions("k", "o").select("value").write.text(f"{folder}/{k}")
    out = captures.read_zeek(spark, f"{folder}/*")
    return out.select("src_ip", "dst_ip", "protocol", "packet_len", "ts_us", F.variant_get("metadata", "$.uid", "string").alias("uid"),
                      F.coalesce("src_port", F.lit(0)).alias("src_port"), F.coalesce("dst_port", F.lit(0)).alias("dst_port"))


@query
def indicator_feed(spark, sf):
    """A feed with comments, blanks, padding and repetitions, one line per traffic row."""
    t = _traffic(spark, sf)
    e = F.col("event_id")
    line = (F.when(e % 50 == 0, F.concat(F.lit("# "), "src_ip")).when(e % 50 == 1, F.lit("  "))
            .when(e % 3 == 0, F.concat(F.lit(" "), "src_ip", F.lit(" "))).otherwise(F.col("src_ip")))
    return ev_src.indicator_lines(t.select(line.alias("value")))


@query
def dataset_gates(spark, sf):
    """Contract violations of customer rows read as text, with flags and numbers as features."""
    raw = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.when(F.col("c_custkey") % 97 == 0, F.lit("x")).when(F.col("c_custkey") % 89 == 0, F.lit("2"))
        .otherwise((F.col("c_nationkey") % 2).cast("string")).alias("label"),
        F.when(F.col("c_custkey") % 31 == 0, F.lit("inf")).otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("True")).when(F.col("c_custkey") % 53 == 0, F.lit("n/a"))
        .otherwise(F.lit("f")).alias("flag"))
    return labelled.gate_report(raw, labelled.Contract())


# --- per-event expressions --------------------------------------------------------------------


@query
def tcp_flag_letters(spark, sf):
    e = tables.events(spark, sf)
    return e.select("event_id", pr.flags_from_bits((F.col("event_id") % 64).cast("int")).alias("from_bits"),
                    pr.flags_from_text(F.col("event_type")).alias("from_text"))


@query
def traffic_direction(spark, sf):
    t = _traffic(spark, sf)
    local = ["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.100", "10.0.3.1"]
    return t.groupBy(pr.direction(F.col("src_ip"), F.col("dst_ip"), local).alias("direction")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def app_protocol(spark, sf):
    t = _traffic(spark, sf)
    return t.select("event_id", pr.app_protocol(F.col("protocol"), F.col("src_port"), F.col("dst_port")).alias("app"))


@query
def ot_observable(spark, sf):
    t = _traffic(spark, sf)
    app = F.coalesce(pr.app_protocol(F.col("protocol"), F.col("src_port"), F.col("dst_port")), F.lit("other"))
    name = F.when(F.col("event_id") % 5 == 0, F.lit("dnp3")).otherwise(app)
    return t.select(pr.observable(name).alias("o")).groupBy("o.protocol", "o.visibility_status").agg(
        F.count(F.lit(1)).alias("n"), F.max("o.protocol_anomaly_score").alias("anomaly"))


@query
def metadata_evidence(spark, sf):
    """Truthiness by type, identity mismatch and alteration over documents built from the rows."""
    e = tables.events(spark, sf)
    k = F.col("event_id") % 12
    bodies = ['{}', '{"payload_altered":true}', '{"payload_altered":1}', '{"packet_altered":"YES"}',
              '{"checksum_valid":false}', '{"checksum_valid":"false"}', '{"payload_hash":"AB","expected_payload_hash":"ab"}',
              '{"payload_sha256":"a","expected_payload_sha256":"b","payload_hash":"x","expected_payload_hash":"x"}',
              '{"observed_src_ip":"10.0.0.9"}', '{"observed_src_ip":"10.0.0.1"}', '{"spoofed":"1"}',
              '{"virtual_identity":false}']
    meta = F.parse_json(F.element_at(F.array(*[F.lit(b) for b in bodies]), (k + 1).cast("int")))
    ip = F.concat(F.lit("10.0.0."), (F.col("user_id") % 2 + 1).cast("string"))
    return e.select("event_id", md.altered(meta).alias("altered"), md.spoofed(meta, ip).alias("spoofed"))


@query
def modbus_decode(spark, sf):
    """Frames of every shape: whole, truncated, wrong length, writes, exceptions, not hex."""
    e = tables.events(spark, sf)
    frames = ["000100000006010300000002", "00010000000601050001ff00", "000100000001015a00", "00010000000101ff00",
              "0001", "zz", "", "000100010006010300000002", "000100000006018300000002", "000200000006010f00100000",
              "00030000000601060001000a", "0004000000060108000007d1"]
    p = F.element_at(F.array(*[F.lit(x) for x in frames]), (F.col("event_id") % 12 + 1).cast("int"))
    return e.select("event_id", pr.modbus(p).alias("m")).select("event_id", "m.*").drop("protocol", "exception_response")


@query
def tls_server_name(spark, sf):
    """Handshakes assembled around a name derived from each row, then read back."""
    e = tables.events(spark, sf)
    name = F.concat(F.lit("host"), F.col("user_id").cast("string"), F.lit(".example"))
    n = F.length(name)
    hx = lambda c, w: F.lpad(F.lower(F.hex(c)), w, "0")
    ext = F.concat(F.lit("0000"), hx(n + 5, 4), hx(n + 3, 4), F.lit("00"), hx(n, 4), F.lower(F.hex(F.encode(name, "UTF-8"))))
    body = F.concat(F.lit("16030100c8010000c40303"), F.repeat(F.lit("ab"), 32), F.lit("00"), F.lit("0002c02f"),
                    F.lit("0100"), hx(F.length(ext) / 2, 4), ext)
    body = F.when(F.col("event_id") % 10 == 0, F.substring(body, 1, 100)).otherwise(body)
    return e.select("event_id", tls.tls_sni(F.unhex(body)).alias("sni"))


@query
def dedup_events(spark, sf):
    """Repeated sightings: the same events reported twice with different ports."""
    t = _traffic(spark, sf).drop("metadata", "timestamp")
    again = t.withColumns({"event_id": F.col("event_id") + 1_000_000_000, "src_port": F.lit(1)}).filter("ttl = 64")
    return _pick(detection.dedup(t.unionByName(again)), "event_id", "ts_us", "src_ip", "dst_ip", "protocol",
                 "packet_len", "src_port")


# --- signatures and reputation ----------------------------------------------------------------


def _rule(spark, sf, *ids):
    return _pick(signatures.matches(_traffic(spark, sf)).filter(F.col("rule_id").isin(*ids)),
                 "event_id", "rule_id", "severity", "evidence")


@query
def sig_xmas_null_synfin(spark, sf):
    return _rule(spark, sf, "SIG-SCAN-001", "SIG-SCAN-002", "SIG-SCAN-003")


@query
def sig_modbus_write(spark, sf):
    return _rule(spark, sf, "SIG-OT-001")


@query
def sig_s7_stop(spark, sf):
    """Stop sequences on the industrial port, in payloads and ports derived from the rows."""
    t = _traffic(spark, sf)
    e = F.col("event_id")
    t = t.withColumns({
        "dst_port": F.when(e % 4 == 0, F.lit(102)).otherwise(F.col("dst_port")),
        "payload_hex": F.when(e % 8 == 0, F.lit("03000029000000000009AA")).when(e % 12 == 0, F.lit("xxSTOPxx"))
        .otherwise(F.col("payload_hex"))})
    return _pick(signatures.matches(t).filter("rule_id = 'SIG-OT-002'"), "event_id", "rule_id", "severity", "evidence")


@query
def sig_telnet(spark, sf):
    return _rule(spark, sf, "SIG-NET-001")


@query
def rule_catalogue_hits(spark, sf):
    return _pick(signatures.rule_hits(_traffic(spark, sf)), "rule_id", "severity", "category", "mitre_technique", "hits")


@query
def signature_signals(spark, sf):
    return _pick(signatures.signature_signals(_traffic(spark, sf)), "event_id", "category", "severity", "evidence", "score")


@query
def syn_flood(spark, sf):
    return _pick(signatures.syn_floods(_traffic(spark, sf), threshold=20), "event_id", "dst_ip", "syn_count")


@query
def intel_join(spark, sf):
    out = intel.check_ip(_traffic(spark, sf), "src_ip", _verdicts(spark))
    return _pick(out, "event_id", "src_ip", "is_malicious", "reputation_score", "source", "attribution")


@query
def intel_join_shuffled(spark, sf):
    """The lookup as it runs when the feed is too large to broadcast."""
    out = intel.check_ip(_traffic(spark, sf), "src_ip", _verdicts(spark), small=False)
    return _pick(out, "event_id", "src_ip", "is_malicious", "reputation_score", "source", "attribution")


@query
def intel_signals(spark, sf):
    return _pick(intel.intel_signals(_traffic(spark, sf), _verdicts(spark)), "event_id", "severity", "evidence", "score")


@query
def abuse_scores(spark, sf):
    """Suppliers as scored addresses: malicious from forty, reputation a hundredth of the score."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.concat(F.lit("198.51.100."), F.col("s_suppkey").cast("string")).alias("indicator"),
        (F.col("s_suppkey") * 7 % 101).cast("int").alias("abuse_score"), F.col("s_nationkey").alias("reports"))
    return intel.reputation(s.limit(0).select("indicator"), s)


@query
def ioc_store_lookup(spark, sf):
    t = _traffic(spark, sf)
    store = t.filter("dst_port = 445").select(F.col("dst_ip").alias("indicator"))
    return intel.ioc_lookup(t, "dst_ip", store).groupBy("dst_ip", "match").agg(F.count(F.lit(1)).alias("n"))


@query
def endpoint_enrichment(spark, sf):
    out = intel.enrich_endpoints(_traffic(spark, sf), _verdicts(spark))
    return out.select("event_id", "threat_intel.status", "threat_intel.ip", "threat_intel.source")


@query
def intel_as_of(spark, sf):
    """Lookups recorded over time; a verdict applies only while it is valid."""
    t = _traffic(spark, sf)
    looked = t.groupBy("src_ip", F.expr("ts_us div 60000000").alias("m")).agg(F.min("ts_us").alias("looked_up_us"))
    looked = looked.select(F.col("src_ip").alias("indicator"), "looked_up_us",
                           ((F.col("m") + F.length("src_ip")) % 3 == 0).alias("is_malicious"))
    cfg = Config(intel_hit_ttl_us=45_000_000, intel_clean_ttl_us=20_000_000)
    out = intel.check_ip_as_of(t, "src_ip", intel.verdict_versions(looked, cfg), bucket_us=10_000_000)
    return out.select("event_id", "is_malicious", "valid_from", "valid_to")


# --- behaviours -------------------------------------------------------------------------------


@query
def port_scan(spark, sf):
    return _pick(behaviors.port_scans(_traffic(spark, sf)), "event_id", "ts_us", "src_ip", "dst_ip", "severity",
                 "score", "evidence")


@query
def host_sweep(spark, sf):
    return _pick(behaviors.host_sweeps(_traffic(spark, sf)), "event_id", "ts_us", "src_ip", "dst_ip", "dst_port",
                 "evidence")


@query
def beacon(spark, sf):
    return behaviors.behaviour_counts(_traffic(spark, sf), rules=("beacon",)).filter("beacon_cv < 0.15").select(
        "event_id", "src_ip", "dst_ip", F.col("_dport").alias("dst_port"), "beacon_intervals", "beacon_mean_s", "beacon_cv")


@query
def rst_storm(spark, sf):
    return _pick(behaviors.rst_storms(_traffic(spark, sf)), "event_id", "ts_us", "src_ip", "dst_ip", "evidence")


@query
def behaviour_counts_slots(spark, sf):
    """The same counts on two levels, as for a source too dense for a chunk."""
    return _pick(behaviors.behaviour_counts(_traffic(spark, sf), Config(behaviour_slot_us=1_000_000), rules=("scan", "sweep", "rst")),
                 "event_id", "port_count", "host_count", "rst_count")


@query
def behaviour_counts(spark, sf):
    """Trailing counts of every row, not only of those past a threshold."""
    return _pick(behaviors.behaviour_counts(_traffic(spark, sf), rules=("scan", "sweep", "rst")),
                 "event_id", "port_count", "host_count", "rst_count")


@query
def all_signals(spark, sf):
    s = detection.signals(_traffic(spark, sf), _verdicts(spark))
    return s.groupBy("detection_method", "category", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("src_ip").alias("sources"), F.sum("score").alias("score"))


# --- correlation ------------------------------------------------------------------------------


@query
def incidents(spark, sf):
    inc = correlate.incidents(detection.signals(_traffic(spark, sf), _verdicts(spark)))
    return inc.select("incident_id", "src_ip", "dst_ip", "category", "first_us", "last_us", "max_severity", "confidence",
                      "event_count", F.array_join("detection_methods", "+").alias("methods"))


@query
def incidents_first_state(spark, sf):
    inc = correlate.incidents(detection.signals(_traffic(spark, sf), _verdicts(spark)), state="first")
    return inc.select("incident_id", "category", "first_us", "max_severity", "confidence", "event_count",
                      F.array_join("detection_methods", "+").alias("methods"), "first_evidence")


@query
def incident_evidence(spark, sf):
    ev = correlate.incident_evidence(signatures.signature_signals(_traffic(spark, sf)))
    return ev.select("incident_id", F.array_join("evidence", " / ").alias("evidence"))


@query
def incident_alerts(spark, sf):
    return _alerts(spark, sf).select(
        "alert_id", "incident_id", "ts_us", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "attack_category",
        "risk_level", "risk_score", "confidence", "detection_method", "recommended_action")


# --- flows ------------------------------------------------------------------------------------


@query
def flow_sessions(spark, sf):
    return _pick(flows.flow_sessions(_conversations(spark, sf)), "flow_id", "src_ip", "dst_ip", "src_port", "dst_port",
                 "protocol", "start_us", "last_us", "duration", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes",
                 "pps", "bps")


@query
def flow_tcp_state(spark, sf):
    return _pick(flows.flow_sessions(_conversations(spark, sf)), "start_us", "src_ip", "src_port", "tcp_state", "flags",
                 "syn_count", "ack_count", "rst_count", "fin_count")


@query
def flow_application_fields(spark, sf):
    return _pick(flows.flow_sessions(_conversations(spark, sf)), "start_us", "src_ip", "src_port", "app_protocol",
                 "tls_sni", "dns_query")


@query
def flow_packet_lists(spark, sf):
    f = flows.flow_sessions(_conversations(spark, sf), Config(flow_iat_keep=5, flow_len_keep=4))
    us = F.transform("inter_arrival_times", lambda x: F.round(x * 1e6).cast("bigint"))
    return f.select("start_us", "src_ip", "src_port", F.array_join(us, ",").alias("iats_us"),
                    F.array_join("fwd_lengths", ",").alias("fwd_lengths"),
                    F.array_join("bwd_lengths", ",").alias("bwd_lengths"))


@query
def flow_stats(spark, sf):
    c = _conversations(spark, sf)
    return flows.flow_stats(flows.flow_sessions(c), c.agg(F.max("ts_us")).scalar())


@query
def active_flows(spark, sf):
    c = _conversations(spark, sf)
    return _pick(flows.active_flows(flows.flow_sessions(c), 25, c.agg(F.max("ts_us")).scalar()), "flow_id", "src_ip", "last_us",
                 "total_packets")


# --- windows ----------------------------------------------------------------------------------


def _features(spark, sf, spectral=False, **kw):
    return features.window_features(_uneven(spark, sf), spectral=spectral, **kw)


@query
def rate_1s(spark, sf):
    return reporting.capture_rate(_uneven(spark, sf))


@query
def window_volume(spark, sf):
    return _pick(_features(spark, sf), "window_end", "packets", "bytes", "packets_per_sec", "bytes_per_sec",
                 "packet_len_mean", "packet_len_std", "ttl_mean", "ttl_delta", "src_ip", "src_port", "dst_port")


@query
def window_distinct(spark, sf):
    return _pick(_features(spark, sf), "window_end", "flow_count", "port_diversity", "destination_diversity",
                 "source_diversity", "fan_out", "fan_in", "new_ip_ratio", "subnet_diversity", "protocol")


@query
def window_entropy(spark, sf):
    return _pick(_features(spark, sf), "window_end", "ip_id_entropy", "ip_flags_entropy", "tcp_flags_entropy", "dscp_entropy")


@query
def window_iat_stats(spark, sf):
    return _pick(_features(spark, sf), "window_end", "iat_mean", "iat_variance", "iat_std", "iat_skewness",
                 "iat_kurtosis", "iat_cv")


@query
def window_indicators(spark, sf):
    return _pick(_features(spark, sf), "window_end", "udp_ratio", "udp_burst_score", "ttl_anomaly_score",
                 "payload_integrity_anomaly", "ip_spoofing_score", "lateral_movement_score", "protocol_type_TCP",
                 "protocol_type_UDP", "tcp_flags_SYN")


@query
def window_spectrum(spark, sf):
    return _pick(_features(spark, sf, True), "window_end", "dominant_frequency", "spectral_flatness", "harmonic_ratio",
                 "spectral_centroid", "periodicity_score")


@query
def window_beacon_behaviour(spark, sf):
    return _pick(_features(spark, sf, True), "window_end", "periodicity_score", "beacon_score", "behavior_anomaly_score")


BASELINE = {"packets": 90.0, "bytes": 9000.0, "fan_out": 3.0, "iat_mean": 0.06, "authorized_peer_status": 0.0}


@query
def window_baseline_deviation(spark, sf):
    return _pick(_features(spark, sf, baseline=BASELINE), "window_end", "baseline_deviation", "authorized_peer_status")


@query
def window_per_asset(spark, sf):
    """Windows of each asset on its own."""
    f = features.window_features(_uneven(spark, sf), group_cols=("asset_id",), spectral=False)
    return f.select("asset_id", "window_end", "packets", "bytes", "fan_out",
                    F.round(F.col("iat_mean") * 1e6, 3).alias("iat_mean_us"))


@query
def window_empty_rows(spark, sf):
    """Silent windows reappear as zero rows; a gap is cut into the traffic first."""
    t = _uneven(spark, sf).filter("event_id % 1000 < 600")
    f = features.with_empty_windows(features.window_features(t, spectral=False))
    return _pick(f, "window_end", "packets", "flow_count", "empty_window")


@query
def window_silences(spark, sf):
    """All events, blocks of a thousand moved ninety seconds apart; the silences between come back as zero rows."""
    moved = F.col("ts_us") + F.expr("event_id div 1000") * 90_000_000
    t = _uneven(spark, sf).withColumn("ts_us", moved)
    f = features.with_empty_windows(features.window_features(t, spectral=False))
    return _pick(f, "window_end", "packets", "flow_count", "empty_window")


@query
def window_partial_tail(spark, sf):
    return _pick(_features(spark, sf, emit_partial=True), "window_end", "packets")


@query
def burst_ratio(spark, sf):
    return _pick(extractor.extract(_uneven(spark, sf)), "window_end", "burst_ratio")


@query
def extracted_features(spark, sf):
    return _pick(extractor.extract(_uneven(spark, sf)), "window_end",
                 *[c for c in extractor.COLUMNS if c != "dominant_frequency"], "src_ip", "dst_ip", "protocol")


@query
def arrival_spectrum(spark, sf):
    return _pick(extractor.extract(_uneven(spark, sf)), "window_end", "dominant_frequency")


# --- scores, risk, explanations ---------------------------------------------------------------


def _model(name: str) -> Column:
    return F.element_at("model_scores", name).alias(name)


@query
def scores_by_model(spark, sf):
    return _assessed(spark, sf).select("window_end", *[_model(m) for m in scoring.MODELS])


@query
def scores_fused(spark, sf):
    return _assessed(spark, sf).select("window_end", "fusion.*")


@query
def window_modbus_evidence(spark, sf):
    f = features.with_protocol(_features(spark, sf))
    return f.select("window_end", "protocol_evidence.function_code", "protocol_evidence.operation",
                    "protocol_evidence.malformed_message_score", "protocol_anomaly_score")


@query
def risk_levels(spark, sf):
    return _assessed(spark, sf).select("window_end", "risk_score", "risk_level", "confidence", "attack_category",
                                       F.array_join("reasons", "; ").alias("reasons"))


@query
def fixed_profile_distance(spark, sf):
    """All numeric features against one fixed profile."""
    means = dict.fromkeys(features.NUMERIC_FEATURES, 2.5)
    return _features(spark, sf, True).select(
        "window_end", scoring.baseline_distance(means, features.NUMERIC_FEATURES).alias("distance"))


@query
def kitsune_online(spark, sf):
    return baseline.online_distance(materialise(_features(spark, sf, True), "features"))


@query
def flow_summary(spark, sf):
    return window_alerts.flow_summary(_assessed(spark, sf))


@query
def persistence_islands(spark, sf):
    return persistence.island_counts(_assessed(spark, sf)).select("src_ip", "window_end", "risk_score", "consecutive")


@query
def persistent_windows(spark, sf):
    return persistence.persistent_hits(_assessed(spark, sf)).select("src_ip", "window_end", "hit_run")


@query
def cooldown(spark, sf):
    a = _assessed(spark, sf).withColumn("src_ip", F.lit("all"))
    return persistence.cooldown(persistence.persistent_hits(a).filter("hit_run"), cfg=Config(cooldown_us=7_000_000))


@query
def emission_gate(spark, sf):
    a = persistence.with_persistence(_assessed(spark, sf))
    return persistence.emission_gate(a).select("window_end", "src_ip", "risk_level", "persistent")


@query
def window_alerts_report(spark, sf):
    """Window alerts with the online model, endpoint reputation and top evidence."""
    out = window_alerts.window_alerts(_assessed(spark, sf), _verdicts(spark))
    return out.select("alert_id", "ts_us", "src_ip", "dst_ip", "protocol", "attack_category", "risk_level", "risk_score",
                      "threat_intel.status", F.element_at("top_features", 1)["feature"].alias("top_feature"))


@query
def explain_topk(spark, sf):
    return explain.contributions(_assessed(spark, sf), ["window_end"])


@query
def explain_nested(spark, sf):
    """The nested explanation, flattened to one row per window and rank."""
    e = explain.explain(_assessed(spark, sf))
    return e.select("window_end", F.posexplode("top_features")).select(
        "window_end", (F.col("pos") + 1).alias("position"), "col.feature", "col.contribution")


# --- moving baselines -------------------------------------------------------------------------


def _volumes(spark, sf):
    return materialise(extractor.extract(_uneven(spark, sf)), "window-volumes")


@query
def ewma_zscore(spark, sf):
    e = baseline.ewma(_volumes(spark, sf)).withColumn("std", F.round(F.sqrt("variance"), 3))
    return _pick(e, "metric", "window_end", "x", "obs", "mean", "std", "zscore", "anomaly_score")


@query
def ewma_verdicts(spark, sf):
    out = baseline.evaluate(baseline.ewma(_volumes(spark, sf)), Config(zscore_flag=2.0, zscore_critical=2.6))
    return out.select("window_end", "composite_anomaly_score", F.size("flagged_reasons").alias("flags"), "is_anomaly")


@query
def volume_signals(spark, sf):
    x = _volumes(spark, sf)
    v = baseline.evaluate(baseline.ewma(x), Config(zscore_flag=2.0))
    return _pick(baseline.volume_signals(x, v), "ts_us", "severity", "src_ip", "dst_ip", "protocol", "score")


@query
def baseline_summary(spark, sf):
    return baseline.summary(baseline.ewma(_volumes(spark, sf)))


# --- reporting --------------------------------------------------------------------------------


@query
def dashboard_grouping_sets(spark, sf):
    return reporting.dashboard(_alerts(spark, sf))


@query
def dashboard_newest(spark, sf):
    return reporting.dashboard(_alerts(spark, sf), newest_only=100)


@query
def heatmap(spark, sf):
    return reporting.heatmap(_alerts(spark, sf))


@query
def report_counts(spark, sf):
    return reporting.report(_alerts(spark, sf), start_us=tables.BASE_US + 10_000_000)


@query
def kpis(spark, sf):
    a, f = _alerts(spark, sf), flows.flow_sessions(_conversations(spark, sf))
    return reporting.kpis(a, f.select(F.col("total_packets").alias("packets"), F.col("total_bytes").alias("bytes")))


@query
def top_categories(spark, sf):
    return reporting.top_categories(_alerts(spark, sf))


@query
def level_counts(spark, sf):
    return reporting.level_counts(_alerts(spark, sf))


@query
def alert_filter(spark, sf):
    return _pick(reporting.filter_alerts(_alerts(spark, sf), severity="HIGH", start_us=tables.BASE_US + 20_000_000,
                                         end_us=tables.BASE_US + 400_000_000), "alert_id", "ts_us", "src_ip")


@query
def alert_lookup(spark, sf):
    """The first alert, found again by its id."""
    a = _alerts(spark, sf)
    return reporting.alert_by_id(a, a.agg(F.min("alert_id")).scalar()).select("alert_id", "attack_category", "risk_level")


@query
def newest_incidents(spark, sf):
    inc = correlate.incidents(detection.signals(_traffic(spark, sf), _verdicts(spark)))
    return _pick(reporting.newest(inc, 60, "last_us", "incident_id"), "incident_id", "src_ip", "category", "last_us", "event_count")


@query
def newest_flows(spark, sf):
    f = flows.flow_sessions(_conversations(spark, sf))
    return _pick(reporting.newest(f, 80, "last_us", "flow_id"), "flow_id", "src_ip", "last_us", "total_packets")


@query
def evidence_chain_newest(spark, sf):
    """The newest links of one sensor's chain."""
    c = _chained(spark, sf).filter("sensor = 0").withColumn("ts_us", F.col("pos"))
    return _pick(reporting.evidence_chain(c, 100), "chain_sequence", "alert_id", "risk_level", "previous_hash", "evidence_hash")


@query
def evidence_chains_newest(spark, sf):
    """The newest links of every sensor's chain."""
    return _pick(reporting.evidence_chains(_chained(spark, sf), ["sensor"], 10), "sensor", "newest", "chain_sequence", "alert_id", "risk_level",
                 "previous_hash", "evidence_hash")


@query
def signal_rows(spark, sf):
    """Every signal of the per-event path, row by row."""
    s = detection.signals(_traffic(spark, sf), _verdicts(spark))
    return _pick(s, "event_id", "ts_us", "category", "detection_method", "severity", "src_ip", "dst_ip", "score", "evidence")


@query
def direction_rows(spark, sf):
    t = _traffic(spark, sf)
    local = ["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.100", "10.0.3.1"]
    return t.select("event_id", pr.direction(F.col("src_ip"), F.col("dst_ip"), local).alias("direction"))


@query
def newest_alerts(spark, sf):
    return _pick(reporting.newest(_alerts(spark, sf), 50), "alert_id", "ts_us")


@query
def retention_topn(spark, sf):
    return _pick(reporting.keep_newest(_alerts(spark, sf), 40), "alert_id", "ts_us")


@query
def assets_latest(spark, sf):
    """Last write per asset, listed by id."""
    t = _traffic(spark, sf).select("asset_id", "src_ip", "protocol", F.col("event_id").alias("_version"))
    return sinks.latest(t, "asset_id", "_version").drop("_version").orderBy("asset_id")


@query
def assets_upserted(spark, sf):
    """Assets merged into hash buckets by four batches, one of them twice; later events win whatever the batch."""
    t = _traffic(spark, sf).select("asset_id", "src_ip", "protocol", "event_id")
    table = KeyedTable(spark, scratch(spark, "assets"), "asset_id", 8)
    for version, part in ((1, 2), (2, 0), (3, 3), (3, 3), (4, 1)):
        table.merge(t.filter(F.col("event_id") % 4 == part), version, "event_id")
    table.vacuum()
    return table.read().select("asset_id", "src_ip", "protocol")


@query
def incidents_upserted(spark, sf):
    """Incidents stored in their first state, then updated to the final one and read back."""
    s = materialise(correlate.fragments(detection.signals(_traffic(spark, sf), _verdicts(spark))), "fragments")
    table = KeyedTable(spark, scratch(spark, "incidents"), "incident_id", 16)
    for version, state in ((1, "first"), (2, "final")):
        table.merge(correlate.incidents(s, state=state), version)
    return table.read().select("incident_id", "src_ip", "dst_ip", "category", "first_us", "last_us", "max_severity", "confidence",
                               "event_count", F.array_join("detection_methods", "+").alias("methods"))


@query
def flows_stored(spark, sf):
    """Flow summaries of windows, stored by day and read back."""
    path = scratch(spark, "stored-flows")
    sinks.save_flows(window_alerts.flow_summary(_assessed(spark, sf)), path, batch_id=0)
    return sinks.read(spark, f"{path}/flows").drop("day", "batch")


@query
def newest_model_scores(spark, sf):
    """Model scores stored by day; the newest hundred windows read back, one column per model."""
    path = scratch(spark, "stored-scores")
    sinks.save_scores(_assessed(spark, sf), path, batch_id=0)
    stored = reporting.newest(sinks.read(spark, f"{path}/model_scores"), 100, "last_us", "window_end")
    return stored.select("window_end", *[F.element_at(F.from_json("scores", "map<string,double>") if
                                                      stored.schema["scores"].dataType.typeName() == "string" else F.col("scores"), m).alias(m)
                                         for m in scoring.MODELS])


@query
def alerts_stored_latest(spark, sf):
    """Alerts stored in both states, read back by latest version with their JSON evidence."""
    path = scratch(spark, "alert-store")
    s = materialise(correlate.fragments(detection.signals(_traffic(spark, sf), _verdicts(spark))), "fragments")
    for state in ("first", "final"):
        sinks.save_alerts(correlate.incident_alerts(correlate.incidents(s, state=state)), path)
    stored = sinks.read(spark, f"{path}/alerts")
    top = sinks.latest(stored, "alert_id", "event_count")
    evidence = sinks.read(spark, f"{path}/alert_evidence").groupBy("alert_id").agg(F.count(F.lit(1)).alias("versions"))
    return top.join(evidence, "alert_id").select("alert_id", "event_count", "risk_level", "versions",
                                                 F.size(F.from_json("all_detection_methods", "array<string>")).alias("methods"))


@query
def feedback_split(spark, sf):
    e = tables.events(spark, sf)
    label = F.when(F.col("event_type") == "click", F.lit("TRUE_POSITIVE")).when(
        F.col("event_type") == "view", F.lit("BENIGN")).when(F.col("event_type") == "error", F.lit("UNKNOWN")).otherwise(
        F.upper("event_type"))
    good, bad = sinks.feedback(e.select(F.col("event_id").cast("string").alias("alert_id"), label.alias("label"),
                                        F.lit(None).cast("string").alias("comment")))
    out = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return out.groupBy("label", "accepted").agg(F.count(F.lit(1)).alias("n"), F.max("comment").alias("comment"))


@query
def audit_log(spark, sf):
    a = sinks.audit_rows(_pick(_traffic(spark, sf), "ts_us", "event_id", "src_ip"), "packet")
    return a.groupBy("event", F.get_json_object("data", "$.src_ip").alias("src_ip")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_us"))


# --- integrity --------------------------------------------------------------------------------


def _chain_input(spark, sf):
    """Orders as alert rows to chain, one chain per sensor."""
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderkey").alias("pos")).agg(
        F.concat(F.lit("a-"), F.col("o_orderkey").cast("string")).alias("alert_id"),
        F.min("o_orderpriority").alias("risk_level"), F.min("o_orderstatus").alias("attack_category"),
        F.concat(F.lit("10.0.0."), F.min("o_custkey").cast("string")).alias("src_ip"),
        F.lit("10.1.0.1").alias("dst_ip"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("timestamp"),
        (F.min("o_custkey") % 40).cast("bigint").alias("sensor"))


SENSOR = ("sensor",)


def _chain_payload(style="full"):
    return integrity.compact_payload() if style == "compact" else F.concat_ws("|", "alert_id", "risk_level", "src_ip")


def _chained(spark, sf, style="full"):
    return integrity.append_chain(_chain_input(spark, sf), "pos", _chain_payload(style), F.col("timestamp"), SENSOR, style)


@query
def chain_append(spark, sf):
    return _pick(_chained(spark, sf), "alert_id", "sensor", "chain_sequence", "previous_hash", "evidence_hash")


@query
def chain_continued(spark, sf):
    """The same chains appended in two parts, the second from the heads of the stored first."""
    rows = _chain_input(spark, sf)
    early = materialise(integrity.append_chain(rows.filter("pos % 4 < 2 AND pos < 30000 OR pos < 9000"), "pos", _chain_payload(),
                                               F.col("timestamp"), SENSOR), "chain")
    late = integrity.append_chain(rows.filter("NOT (pos % 4 < 2 AND pos < 30000 OR pos < 9000)"), "pos", _chain_payload(),
                                  F.col("timestamp"), SENSOR, heads=integrity.chain_heads(early, SENSOR))
    return _pick(early.unionByName(late), "alert_id", "sensor", "chain_sequence", "evidence_hash")


@query
def chain_compact(spark, sf):
    return _pick(_chained(spark, sf, "compact"), "alert_id", "sensor", "chain_sequence", "evidence_hash")


@query
def chain_heads(spark, sf):
    """Heads of all chains, and their own chain."""
    heads = integrity.head_chain(integrity.chain_heads(_chained(spark, sf), SENSOR), SENSOR)
    return _pick(heads, "sensor", "rows", "head_sequence", "head_hash", "chain_sequence", "evidence_hash")


@query
def chain_segment_heads(spark, sf):
    """The last link of each chain."""
    return _pick(integrity.chain_heads(_chained(spark, sf), SENSOR), "sensor", "head_hash", "head_sequence")


@query
def chain_links(spark, sf):
    """Link and payload checks after some rows were tampered with."""
    c = materialise(_chained(spark, sf), "chain")
    e = F.col("pos")
    bad = c.withColumns({
        "risk_level": F.when(e % 101 == 7, F.lit("edited")).otherwise(F.col("risk_level")),
        "previous_hash": F.when(e % 103 == 5, F.repeat(F.lit("f"), 64)).otherwise(F.col("previous_hash"))})
    out = integrity.check_links(bad, _chain_payload(), F.col("timestamp"), chunk=64, keys=SENSOR)
    return _pick(out, "alert_id", "link_ok", "payload_ok")


@query
def chain_first_break(spark, sf):
    """Verification of every chain, with the twelfth row of every third one edited."""
    c = materialise(_chained(spark, sf), "chain")
    edit = (F.col("chain_sequence") == 12) & (F.col("sensor") % 3 == 0)
    bad = c.withColumn("risk_level", F.when(edit, F.lit("edited")).otherwise(F.col("risk_level")))
    return integrity.verify_chain(bad, _chain_payload(), F.col("timestamp"), chunk=50, keys=SENSOR).drop("head_hash")


@query
def chain_removed_rows(spark, sf):
    """Verification against stored heads after a middle row, a tail and a whole chain were removed."""
    c = materialise(_chained(spark, sf), "chain")
    heads = integrity.chain_heads(c, SENSOR)
    last = F.max("chain_sequence").over(Window.partitionBy("sensor"))
    case = F.col("sensor") % 4
    left = c.withColumn("_last", last).filter(~(
        (case == 0) & (F.col("chain_sequence") == 5) | (case == 1) & (F.col("chain_sequence") > F.col("_last") - 3)
        | (F.col("sensor") == 2))).drop("_last")
    return integrity.verify_chain(left, _chain_payload(), F.col("timestamp"), chunk=64, keys=SENSOR, heads=heads).drop("head_hash")


@query
def alert_verdict_view(spark, sf):
    v = reporting.verdict_view(_alerts(spark, sf))
    return v.select("alert_id", "verdict.category", "verdict.risk_level", "evidence.source", "evidence.destination")


# --- datasets, metrics, models ----------------------------------------------------------------


@query
def roc_auc(spark, sf):
    return metrics.roc_auc(_scored(spark, sf))


@query
def pr_auc(spark, sf):
    return metrics.pr_auc(_scored(spark, sf), id_chunk=64)


@query
def best_threshold(spark, sf):
    return metrics.best_threshold(_scored(spark, sf))


@query
def classification(spark, sf):
    return metrics.confusion(_scored(spark, sf), [], threshold=0.4)


@query
def latency_percentiles(spark, sf):
    return training.latency(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice")


@query
def temporal_split(spark, sf):
    out = splits.temporal(_traffic(spark, sf), "ts_us", "event_id")
    return _pick(out, "event_id", "split")


@query
def group_split(spark, sf):
    o = spark.read.parquet(f"{sf}/customer.parquet").withColumn(
        "g", F.concat(F.lit("g"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")))
    return splits.by_group(o, "g").groupBy("g", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def stratified_split(spark, sf):
    rows, _ = _labelled(spark, sf)
    return splits.stratified(rows, "label", "row_id").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def profile_fit(spark, sf):
    rows, cols = _labelled(spark, sf)
    return models.profile(rows, cols)


@query
def profile_score(spark, sf):
    rows, cols = _labelled(spark, sf)
    means, stds = models.fit_profile(rows, cols)
    return rows.select("row_id", scoring.profile_distance(means, stds).alias("score"))


@query
def row_robust_score(spark, sf):
    rows, cols = _labelled(spark, sf)
    return rows.select("row_id", scoring.row_robust_score(cols).alias("score"))


@query
def calibrated_probability(spark, sf):
    s = _scored(spark, sf)
    return s.select("row_id", scoring.calibrated(F.col("score"), 0.97, -0.17).alias("probability"))


@query
def calibration_newton(spark, sf):
    """The optimum of the calibration likelihood."""
    w, b = models.calibrate_newton(_scored(spark, sf), raw="score")
    return _scored(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.lit(w).alias("weight"), F.lit(b).alias("bias"))


@query
def calibration_steps(spark, sf):
    w, b = models.calibrate_steps(_scored(spark, sf), raw="score")
    return _scored(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.lit(w).alias("weight"), F.lit(b).alias("bias"))


@query
def gbt_scores(spark, sf):
    rows, cols = _labelled(spark, sf)
    s = splits.stratified(rows, "label", "row_id")
    model = models.fit_boosted(s.filter("split = 'train'"), cols, trees=30, depth=6)
    return models.score_model(model, s.filter("split = 'test'"), cols).select("row_id", "score")


@query
def isolation_forest(spark, sf):
    rows, cols = _labelled(spark, sf)
    model = models.fit_isolation(rows.filter("label = 0"), cols, "row_id")
    return rows.select("row_id", models.isolation_score(model).alias("score"))


@query
def ml_cluster_signals(spark, sf):
    """A fitted model over window rows, flagging clusters of high scores."""
    x = _volumes(spark, sf)
    cols = ["pps", "bps", "unique_dst_ports", "tcp_ratio", "udp_ratio", "syn_ratio", "mean_len", "iat_mean", "port_entropy"]
    model = models.fit_boosted(x.withColumn("label", (F.col("unique_dst_ports") > 8).cast("int")), cols, trees=20, depth=4)
    return _pick(models.cluster_signals(model, x, 0.6), "ts_us", "category", "severity", "score")


@query
def window_score_profile(spark, sf):
    """Spread of every model's scores per traffic block kind."""
    a = _assessed(spark, sf).withColumn("scenario", F.concat(F.lit("k"), F.expr(
        f"((window_end - {tables.BASE_US}) div 20000000) % 5").cast("string")))
    return reporting.score_profile(a)


@query
def evaluation_harness(spark, sf):
    """Confusion of all models and the fusion at one half; scan, sweep and beacon blocks are positive."""
    kind = F.expr(f"((window_end - {tables.BASE_US}) div 20000000) % 5")
    return training.harness(_assessed(spark, sf).withColumn("label", kind.isin(1, 2, 3).cast("int")))


@query
def branch_training(spark, sf):
    """Train, calibrate, pick a threshold and evaluate the distance branch."""
    rows, cols = _labelled(spark, sf)
    s = materialise(splits.stratified(rows, "label", "row_id"), "split")
    r = training.train_branch("kitsune", s, cols)
    m = r["metrics"]
    return s.agg(F.count(F.lit(1)).alias("rows"), F.lit(r["threshold"]).alias("threshold"),
                 *[F.lit(float(m[k])).alias(k) for k in ("precision", "recall", "f1", "roc_auc", "pr_auc")])


# --- streaming --------------------------------------------------------------------------------


def _stream(spark, sf, jitter=False):
    return tables.traffic(tables.events_stream(spark, sf), jitter)


@query
def stream_window_volume(spark, sf):
    return run.drain(stream_windows.volumes(_stream(spark, sf, True)), "volumes")


@query
def stream_window_values(spark, sf):
    return run.drain(stream_windows.value_features(_stream(spark, sf, True)), "values")


@query
def stream_dedup(spark, sf):
    t = _stream(spark, sf).drop("metadata")
    twice = t.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return run.drain(stream_windows.dedup(twice).select("ts_us", "src_ip", "dst_ip", "packet_len"), "dedup")


def _stream_columns(t):
    return t.drop("metadata")


def _stream_signals(spark, sf):
    base = scratch(spark, "signals")
    writer = detect.signals_writer(
        _stream(spark, sf), f"{base}/state",
        lambda d, i: d.write.mode("overwrite").parquet(f"{base}/out/batch={i}"), _verdicts(spark))
    run.drain_writer(writer, f"{base}/checkpoint")
    return f"{base}/out"


@query
def stream_signals_late(spark, sf):
    """Behaviour signals of four micro-batches whose rows arrive up to six seconds late."""
    late, t = 6_000_000, _traffic(spark, sf)
    arrival = t.withColumn("_at", F.col("ts_us") + F.pmod(F.xxhash64("event_id"), F.lit(late)))
    cut = arrival.agg(F.percentile_approx("_at", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first().q or []
    base = scratch(spark, "late")
    for i in range(len(cut) + 1):
        part = arrival.filter((F.col("_at") > (cut[i - 1] if i else -1)) & (F.col("_at") <= (cut[i] if i < len(cut) else 1 << 62)))
        detect.behaviour_batch(part.drop("_at"), f"{base}/state", i, lateness_us=late).write.parquet(f"{base}/out/batch={i}")
    detect.flush(spark, t.drop("metadata").schema, f"{base}/state", len(cut) + 1, late).write.parquet(f"{base}/out/batch=99")
    return _pick(spark.read.parquet(f"{base}/out"), "event_id", "ts_us", "category", "src_ip", "dst_ip", "evidence")


@query
def stream_signals(spark, sf):
    out = spark.read.parquet(_stream_signals(spark, sf))
    return out.groupBy("detection_method", "category", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("src_ip").alias("sources"), F.sum("score").alias("score"))


@query
def stream_published(spark, sf):
    """Two tables published per micro-batch; one batch is repeated and one never commits."""
    path, t = scratch(spark, "published"), _stream_columns(_traffic(spark, sf))
    views = {"volumes": lambda d: d.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_len").alias("bytes")),
             "sources": lambda d: d.select("protocol", "src_ip").distinct()}

    def failing(d):
        raise RuntimeError("this table is not written")

    for i in (0, 1, 1, 2):
        publish.publish(t.filter(F.col("event_id") % 3 == i), i, path, views)
    try:
        publish.publish(t, 3, path, {**views, "failing": failing})
    except RuntimeError:
        pass
    v = publish.published(spark, path, "volumes").groupBy("protocol").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    s = publish.published(spark, path, "sources").select("protocol", "src_ip").distinct().groupBy("protocol").agg(F.count(F.lit(1)).alias("sources"))
    return v.join(s, "protocol")


@query
def stream_health(spark, sf):
    """Counters of a stream's micro-batches, as the health view shows them."""
    health = run.watch(spark, "health")
    try:
        arriving = tables.arriving(_stream_columns(_traffic(spark, sf)), f"{scratch(spark, 'health')}/in", 3)
        run.drain(run.observed(arriving, "health").select("event_id"), "health-out")
        run.settled(health)
        return spark.createDataFrame([(health.packets, health.last_event)], "packets long, last_event timestamp").select(
            "packets", F.unix_micros("last_event").alias("last_us"))
    finally:
        spark.streams.removeListener(health)


@query
def stream_incidents_closed(spark, sf):
    """Signals of a stream, streamed again into sessions."""
    path = _stream_signals(spark, sf)
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).parquet(path).withColumn("timestamp", F.timestamp_micros("ts_us"))
    out = run.drain(stream_incidents.incidents(s), "incidents")
    return out.select("src_ip", "dst_ip", "category", "first_us", "last_us", "event_count", "max_severity",
                      F.array_join("detection_methods", "+").alias("methods"), "confidence")


def _flow_stream(spark, sf, **arrival):
    """Flows of a stream of conversations, written per micro-batch; (folder, next batch number, schema of the packets)."""
    base, batches = scratch(spark, "stream-flows"), []
    t = tables.conversations_traffic(tables.events(spark, sf))
    in_order = {} if arrival else {"lateness_us": 0, "grace_us": 6_000_000}
    packets = tables.arriving(t, f"{base}/in", **arrival) if arrival else tables.conversations_traffic(tables.events_stream(spark, sf))

    def sink(found, i):
        found.write.mode("overwrite").parquet(f"{base}/out/batch={i}")
        batches.append(i)

    run.drain_writer(stream_flows.flows_writer(packets, f"{base}/state", sink, **in_order), f"{base}/checkpoint")
    return base, max(batches, default=-1) + 1, t.schema


@query
def stream_flows_closed(spark, sf):
    base, n, _ = _flow_stream(spark, sf)
    return _pick(spark.read.parquet(*[f"{base}/out/batch={i}" for i in range(n)]), "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                 "start_us", "last_us", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "tcp_state")


@query
def stream_flow_sessions(spark, sf):
    """All columns of all flows, from four micro-batches with packets up to five seconds late, and the flush."""
    base, n, schema = _flow_stream(spark, sf, late_us=5_000_000)
    stream_flows.flush(spark, schema, f"{base}/state", n).write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    f = spark.read.parquet(*[f"{base}/out/batch={i}" for i in range(n + 1)])
    return _pick(f, "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_us", "last_us", "duration",
                 "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "pps", "bps", "tcp_state", "flags", "syn_count", "ack_count",
                 "rst_count", "fin_count", "app_protocol", "tls_sni", "dns_query")




def _alert_stream(spark, sf, emit_partial=False, late=5_000_000):
    """Window alerts of three micro-batches, rows up to five seconds out of order, and of the final flush; the folder of the state."""
    base = scratch(spark, "stream-alerts")
    t = _uneven(spark, sf).drop("metadata")
    arriving = tables.arriving(t, f"{base}/in", 3, late_us=late)
    batches = []

    def sink(found, i):
        found.write.mode("overwrite").parquet(f"{base}/out/batch={i}")
        batches.append(i)

    run.drain_writer(stream_alerts.alerts_writer(arriving, f"{base}/state", sink, _verdicts(spark)), f"{base}/checkpoint")
    last = max(batches, default=-1) + 1
    tail = stream_alerts.flush(spark, t.schema, f"{base}/state", last, _verdicts(spark), emit_partial=emit_partial)
    tail.write.mode("overwrite").parquet(f"{base}/out/batch={last}")
    return base, last


@query
def stream_window_alerts(spark, sf):
    """Alerts of a stream: features, online model, risk, persistence and cool-down carried across micro-batches."""
    base, last = _alert_stream(spark, sf)
    out = spark.read.parquet(*[f"{base}/out/batch={i}" for i in range(last + 1)])
    return out.select("alert_id", "ts_us", "src_ip", "dst_ip", "protocol", "attack_category", "risk_level", "risk_score",
                      "threat_intel.status", F.element_at("top_features", 1)["feature"].alias("top_feature"))


@query
def stream_window_tail(spark, sf):
    """Windows of a stream with those that its flush closes before their time."""
    base = scratch(spark, "stream-tail")
    t = _uneven(spark, sf).drop("metadata")
    found = []

    def features_of(batch, i, flush=False):
        state = State(spark, f"{base}/state", i)
        f, _ = stream_alerts.closed_features(batch, state, flush=flush, emit_partial=flush)
        f.select("window_end", "packets").write.mode("overwrite").parquet(f"{base}/out/batch={i}")
        found.append(i)

    writer = tables.arriving(t, f"{base}/in", 3, late_us=5_000_000).writeStream.foreachBatch(features_of)
    run.drain_writer(writer, f"{base}/checkpoint")
    features_of(spark.createDataFrame([], t.schema), max(found, default=-1) + 1, flush=True)
    return spark.read.parquet(*[f"{base}/out/batch={i}" for i in sorted(set(found))])
