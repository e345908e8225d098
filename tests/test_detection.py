import pytest
from pyspark.sql import functions as F

from helpers import T0, rows_of, traffic
from tapline.config import Config
from tapline.functions import metadata as md
from tapline.functions import protocol as pr
from tapline.functions import tls
from tapline.operators import behaviors, correlate, intel, signatures
from tapline.plans import detection


def test_port_scan_of_25_ports(spark):
    t = traffic(spark, [{"at": p * 0.01, "dst_port": p, "tcp_flags": "S"} for p in range(1, 26)], src_ip="10.0.0.99")
    hits = behaviors.port_scans(t).collect()
    assert len(hits) == 6 and {h.category for h in hits} == {"PORT_SCAN"}
    assert "probed 25 unique" in max(h.evidence for h in hits)


def test_beacon_of_seven_events(spark):
    t = traffic(spark, [{"at": i * 0.5} for i in range(7)], src_ip="10.0.0.55", dst_ip="198.51.100.4", dst_port=4444)
    hits = behaviors.beacons(t).collect()
    assert len(hits) == 3 and all(h.severity == "HIGH" for h in hits)
    assert "mean=0.50s" in hits[0].evidence


def test_dense_flow_is_no_beacon(spark):
    t = traffic(spark, [{"at": i * 0.1} for i in range(200)], dst_port=4444)
    assert behaviors.beacons(t).count() == 0


def test_rst_storm_and_sweep(spark):
    t = traffic(spark, [{"at": i * 0.05, "tcp_flags": "RA", "dst_ip": f"10.0.1.{i}", "dst_port": 445} for i in range(30)])
    got = {r.category: r.n for r in behaviors.behavioural_signals(t).groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert got == {"CONNECTION_ANOMALY": 6, "NETWORK_SWEEP": 16}


def _brute(events):
    out = []
    for i, e in enumerate(events):
        past = events[:i + 1]
        near = lambda h: [x for x in past if x["src_ip"] == e["src_ip"] and e["us"] - x["us"] <= h]
        out.append((i, len({x["dst_port"] for x in near(2e6) if x["dst_ip"] == e["dst_ip"]}),
                    len({x["dst_ip"] for x in near(2e6) if x["dst_port"] == e["dst_port"]}),
                    sum("R" in x["tcp_flags"] for x in near(10e6))))
    return out


@pytest.mark.parametrize("chunk", [10_000_000, 40_000_000, 3_600_000_000])
def test_trailing_counts_equal_brute_force(spark, chunk):
    """Ties, repeated values, horizon edges and one source holding nearly all rows."""
    rows = [{"at": (i * 7 % 11) * 0.25 + (i // 11) * 1.0, "src_ip": "10.0.0.1" if i % 9 else "10.0.0.2",
             "dst_ip": f"10.0.1.{i * 5 % 7}", "dst_port": i * 3 % 13, "tcp_flags": "R" if i % 4 == 0 else "S"}
            for i in range(400)]
    rows.sort(key=lambda r: r["at"])
    t = traffic(spark, rows)
    got = behaviors.behaviour_counts(t, Config(chunk_us=chunk), ("scan", "sweep", "rst"))
    events = [{**r, "us": round(r["at"] * 1e6)} for r in rows]
    assert sorted(tuple(r) for r in got.select("event_id", "port_count", "host_count", "rst_count").collect()) == _brute(events)


@pytest.mark.parametrize("slot", [250_000, 700_001, 1_000_000, 2_000_000])
def test_two_level_counts_equal_brute_force(spark, slot):
    """Equal times, values that stay, leave and come back, slot and horizon edges, null endpoints."""
    rows = [{"at": (i * 7 % 11) * 0.25 + (i // 11) * 1.0, "src_ip": "10.0.0.1" if i % 9 else "10.0.0.2",
             "dst_ip": f"10.0.1.{i * 5 % 7}", "dst_port": i * 3 % 13, "tcp_flags": "R" if i % 4 == 0 else "S"} for i in range(300)]
    rows += [{"at": 40 + i * 2.0, "dst_ip": "10.0.1.9", "dst_port": 1, "tcp_flags": "R", "src_ip": "10.0.0.3"} for i in range(12)]
    rows += [{"at": 70 + i * 2.000001, "dst_ip": "10.0.1.9", "dst_port": i % 2, "tcp_flags": "R", "src_ip": "10.0.0.3"} for i in range(12)]
    rows += [{"at": 90 + i * 0.001, "dst_ip": f"10.0.2.{i % 40}", "dst_port": i % 50, "tcp_flags": "S", "src_ip": "10.0.0.4"} for i in range(300)]
    rows.sort(key=lambda r: r["at"])
    cfg = Config(behaviour_slot_us=slot)
    got = behaviors.behaviour_counts(traffic(spark, rows), cfg, ("scan", "sweep", "rst"))
    events = [{**r, "us": round(r["at"] * 1e6)} for r in rows]
    assert sorted(tuple(r) for r in got.select("event_id", "port_count", "host_count", "rst_count").collect()) == _brute(events)
    t = traffic(spark, [{**r, "dst_ip": None if i % 5 == 0 else r["dst_ip"], "dst_port": None if i % 7 == 0 else r["dst_port"]}
                        for i, r in enumerate(rows)])
    cols = ["event_id", "port_count", "host_count", "rst_count"]
    assert rows_of(behaviors.behaviour_counts(t, cfg, ("scan", "sweep", "rst")).select(cols)) == rows_of(
        behaviors.behaviour_counts(t, Config(), ("scan", "sweep", "rst")).select(cols))
    assert rows_of(behaviors.behavioural_signals(t, cfg)) == rows_of(behaviors.behavioural_signals(t))


def test_two_level_counts_split_a_hot_source(spark):
    """Half of all rows come from one source within one chunk: no task of the row shuffle holds over a sixth of its rows."""
    rows = [{"at": i * 0.01, "src_ip": "10.0.0.1" if i % 2 else f"10.0.0.{i % 90}", "dst_port": i % 40} for i in range(3900)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = behaviors.behaviour_counts(traffic(spark, rows), Config(behaviour_slot_us=1_000_000), ("scan", "sweep", "rst"))
        per_task = got.filter("src_ip = '10.0.0.1'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert per_task <= 1950 // 6  # forty slots over 64 tasks; chunks would leave all 1,950 to one


def test_signature_fixtures(spark):
    t = traffic(spark, [
        {"at": 0, "tcp_flags": "FPU"}, {"at": 1, "tcp_flags": "", "packet_len": 40},
        {"at": 2, "dst_port": 502, "payload_hex": "00010000000601050001ff00", "tcp_flags": "PA"},
        {"at": 3, "tcp_flags": None}, {"at": 4, "tcp_flags": "A", "dst_port": 102, "payload_hex": "29000000000009"}])
    got = {(r.event_id, r.rule_id) for r in signatures.matches(t).collect()}
    assert got == {(0, "SIG-SCAN-001"), (1, "SIG-SCAN-002"), (2, "SIG-OT-001"), (3, "SIG-SCAN-002"), (4, "SIG-OT-002")}
    strict = {r.event_id for r in signatures.matches(t, null_is_zero_flags=False).filter("rule_id = 'SIG-SCAN-002'").collect()}
    assert strict == {1}


def test_rules_can_be_disabled_and_added(spark):
    t = traffic(spark, [{"at": 0, "dst_port": 23, "tcp_flags": "S"}])
    off = [signatures.Rule(**{**r.__dict__, "enabled": False}) for r in signatures.CATALOGUE]
    own = signatures.Rule("OWN-1", "n", "d", "LOW", "X", "T0", "dport = 23", "'seen'")
    assert [r.rule_id for r in signatures.matches(t, [*off, own]).collect()] == ["OWN-1"]
    assert signatures.catalogue(spark).count() == 7


def test_private_addresses_are_not_looked_up(spark):
    t = traffic(spark, [{"at": i, "src_ip": ip} for i, ip in enumerate(
        ["192.168.1.1", "127.0.0.1", "172.16.0.1", "203.0.113.7", "10.1.1.1"])])
    ex = spark.createDataFrame([(x,) for x in ("192.168.1.1", "172.16.0.1", "10.1.1.1")], "indicator string")
    ab = spark.createDataFrame([("203.0.113.7", 39, 2), ("172.16.0.1", 90, 1)], "indicator string, abuse_score int, reports int")
    v = intel.reputation(ex, ab)
    got = {r.src_ip: (r.is_malicious, r.source) for r in intel.check_ip(t, "src_ip", v).collect()}
    assert got == {"192.168.1.1": (False, "LocalSubnetFilter"), "127.0.0.1": (False, "LocalSubnetFilter"),
                   "10.1.1.1": (False, "LocalSubnetFilter"), "172.16.0.1": (True, "TorProject-ExitDirectory"),
                   "203.0.113.7": (False, "AbuseIPDB")}
    assert [s.severity for s in intel.intel_signals(t, v).collect()] == ["CRITICAL"]


def _signal_rows(spark, rows):
    return spark.createDataFrame(
        [(r[0], r[1], r[2], "198.51.100.9", "10.0.0.2", r[3], T0 + int(r[4] * 1e6), i, 0) for i, r in enumerate(rows)],
        "category string, detection_method string, severity string, src_ip string, dst_ip string, evidence string, "
        "ts_us long, event_id long, seq int").withColumns({
            "src_port": F.lit(None).cast("int"), "dst_port": F.lit(None).cast("int"), "protocol": F.lit("TCP")})


def test_correlation_upgrades_within_the_gap(spark):
    s = _signal_rows(spark, [("PORT_SCAN", "Signature Detection", "MEDIUM", "Xmas Scan", 0),
                             ("PORT_SCAN", "Behavioral Detection", "HIGH", "25 ports probed", 10),
                             ("PORT_SCAN", "Signature Detection", "LOW", "later", 20.000001)])
    final = sorted(correlate.incidents(s).collect(), key=lambda r: r.first_us)
    assert [(r.event_count, r.max_severity) for r in final] == [(2, "HIGH"), (1, "LOW")]
    assert final[0].detection_methods == ["Behavioral Detection", "Signature Detection"]
    assert final[0].confidence == pytest.approx(0.86)
    first = correlate.incidents(s, state="first").filter("max_severity = 'MEDIUM'").first()
    assert (first.event_count, first.confidence, first.first_evidence) == (1, 0.75, "Xmas Scan")
    ev = {r.incident_id: r.evidence for r in correlate.incident_evidence(s).collect()}
    assert ev[final[0].incident_id] == ["Xmas Scan", "25 ports probed"]


def test_long_incident_spans_buckets(spark):
    s = _signal_rows(spark, [("A", "m", "LOW", f"e{i}", i * 9.5) for i in range(50)])
    one = correlate.incidents(s).collect()
    assert len(one) == 1 and one[0].event_count == 50
    assert correlate.incident_evidence(s).first().evidence == [f"e{i}" for i in range(10)]


def test_both_states_follow_from_one_table_of_fragments(spark):
    s = _signal_rows(spark, [("A", "m", "LOW", f"e{i}", i * 9.5 + (i > 7) * 40) for i in range(20)] + [("B", "n", "HIGH", "x", 3)])
    parts = correlate.fragments(s)
    for state in ("first", "final"):
        assert sorted(correlate.incidents(parts, state=state).collect()) == sorted(correlate.incidents(s, state=state).collect())


def test_alert_rows(spark):
    s = _signal_rows(spark, [("INSECURE_PROTOCOL", "Signature Detection", "MEDIUM", "x", 0)])
    a = correlate.incident_alerts(correlate.incidents(s, state="first")).first()
    assert a.risk_score == 0.6 and a.recommended_action.startswith("CRITICAL: Check physical plant")


def test_dedup_keeps_the_first(spark):
    t = traffic(spark, [{"at": 0, "src_port": 1}, {"at": 0, "src_port": 2}, {"at": 0, "packet_len": 5}])
    got = detection.dedup(t.drop("metadata")).orderBy("event_id").collect()
    assert [(r.event_id, r.src_port) for r in got] == [(0, 1), (2, None)]


def test_metadata_truth(spark):
    docs = ['{"spoofed":true}', '{"spoofed":1}', '{"spoofed":"Yes"}', '{"wire_src_ip":"10.9.9.9"}', '{"wire_src_ip":""}',
            '{"payload_hash":"A","expected_payload_hash":"a","packet_hash":"x","expected_packet_hash":"y"}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    m = F.parse_json("d")
    got = df.select("i", md.spoofed(m, F.lit("10.0.0.1")).alias("s"), md.altered(m).alias("a")).orderBy("i").collect()
    assert [r.s for r in got] == [True, False, True, True, False, False]
    assert [r.a for r in got] == [False] * 6


def test_modbus_fixtures(spark):
    df = spark.createDataFrame([("000100000006010300000002",), ("00010000000601050001ff00",), ("000100000001015a00",),
                                (None,)], "p string")
    m = [r.m for r in df.select(pr.modbus(F.col("p")).alias("m")).collect()]
    assert (m[0].function_code, m[0].starting_address, m[0].protocol_anomaly_score) == (3, 0, 0.0)
    assert (m[1].operation, m[1].malformed_message_score) == ("write", 0.7)
    assert (m[2].malformed_message_score, m[2].unexpected_function_score) == (0.8, 1.0)
    assert m[3].protocol_anomaly_score == 0.2
    lenient = df.select(pr.modbus(F.col("p"), "multi_only").alias("m")).collect()[1].m
    assert lenient.malformed_message_score == 0.0


def test_server_name_truncations():
    name = b"plc.example"
    ext = b"\x00\x00" + (len(name) + 5).to_bytes(2, "big") + (len(name) + 3).to_bytes(2, "big") + b"\x00" + len(name).to_bytes(2, "big") + name
    hello = b"\x16\x03\x01\x00\x00\x01\x00\x00\x00\x03\x03" + b"r" * 32 + b"\x00" + b"\x00\x02\xc0\x2f" + b"\x01\x00" + len(ext).to_bytes(2, "big") + ext
    assert tls.server_name(hello) == "plc.example"
    assert all(tls.server_name(hello[:n]) is None for n in range(len(hello)))
    assert tls.server_name(None) is None
