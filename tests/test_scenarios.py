"""Recorded score means of ten fixed event patterns."""

import pytest
from pyspark.sql import functions as F

from tapline.config import Config
from tapline.operators import features, reporting, scoring

# Pattern name to (events, seconds of event i, source, destination, source port, destination port,
# protocol, length).
PATTERNS = {
    "normal": (15, lambda i: i * 2, "10.0.1.50", lambda i: "8.8.8.8", lambda i: 55000 + i,
               lambda i: 443 if i % 2 else 80, "TCP", lambda i: 1400 + i % 100),
    "udp_burst": (100, lambda i: i * 0.01, "192.168.1.100", lambda i: "10.0.0.10", lambda i: 12345,
                  lambda i: 19001, "UDP", lambda i: 1472),
    "tcp_scan": (90, lambda i: (20 + 2 * i) * 0.005, "203.0.113.50", lambda i: "10.0.1.0", lambda i: 50020 + 2 * i,
                 lambda i: 20 + 2 * i, "TCP", lambda i: 64),
    "dns_tunnel": (50, lambda i: i * 0.5, "10.0.1.25", lambda i: "8.8.8.8", lambda i: 53500 + i, lambda i: 53, "UDP",
                   lambda i: 200 + 3 * i),
    "lateral_movement": (10, lambda i: i * 1.5, "10.0.1.50", lambda i: f"10.0.1.{100 + i}", lambda i: 40000 + i,
                         lambda i: 445, "TCP", lambda i: 256),
    "protocol_anomaly": (25, lambda i: i * 0.1, "192.168.0.10", lambda i: "10.0.0.2", lambda i: 40000 + i,
                         lambda i: 502, "TCP", lambda i: 256),
    "data_exfiltration": (30, lambda i: i * 0.3, "10.0.1.50", lambda i: "external.com", lambda i: 50000 + i,
                          lambda i: 443, "TCP", lambda i: 65535 - i % 100),
    "resource_exhaustion": (40, lambda i: i * 0.025, "10.0.1.99", lambda i: "10.0.0.1", lambda i: 60000 + i,
                            lambda i: 80, "TCP", lambda i: 1460),
    "beaconing": (12, lambda i: i * 30, "10.0.1.75", lambda i: "c2.attacker.com", lambda i: 50000 + i, lambda i: 443,
                  "TCP", lambda i: 256),
    "encryption_anomaly": (20, lambda i: i * 0.5, "10.0.1.33", lambda i: "vpn.provider.com", lambda i: 55000 + i,
                           lambda i: 1194, "UDP", lambda i: 1400),
}
# Tabular, sequence, spectral, isolation, fused.
EXPECTED = {
    "normal": (.0626, .4737, .4583, .02, .1905), "udp_burst": (.24, .5785, .53, .22, .3132),
    "tcp_scan": (.19, .1537, .4305, .02, .1733), "dns_tunnel": (.0578, .472, .435, .0241, .1852),
    "lateral_movement": (.4057, .5187, .9, .2, .421), "protocol_anomaly": (.12, .1335, .445, .02, .1434),
    "data_exfiltration": (.19, .4715, .4417, .02, .2385), "resource_exhaustion": (.19, .5033, .5375, .02, .2593),
    "beaconing": (.0403, .4715, .4667, .02, .1824), "encryption_anomaly": (.1299, .5567, .55, .0259, .2484),
}
# The base time the patterns were recorded at: five minutes between windows from this day on.
START = 1_767_225_600_000_000


@pytest.fixture(scope="module")
def scored(spark):
    data = []
    for name, (n, at, src, dst, sport, dport, proto, size) in PATTERNS.items():
        base = START + _offset(name) * 300_000_000
        for i in range(n):
            data.append((name, i, base + round(at(i) * 1e6), src, dst(i), sport(i), dport(i), proto, size(i)))
    df = spark.createDataFrame(data, "scenario string, event_id long, ts_us long, src_ip string, dst_ip string, "
                                     "src_port int, dst_port int, protocol string, packet_len long")
    df = df.withColumns({"ttl": F.lit(None).cast("int"), "tcp_flags": F.lit(None).cast("string"),
                         "payload_hex": F.lit(None).cast("string")})
    f = features.window_features(df, Config(iat_mode="double"), ("scenario",), whole=True)
    return reporting.score_profile(scoring.fuse(scoring.score(f))).collect()


def _offset(name):
    counts = {"normal": 100, "udp_burst": 80, "tcp_scan": 60, "dns_tunnel": 40, "lateral_movement": 50,
              "protocol_anomaly": 45, "data_exfiltration": 35, "resource_exhaustion": 30, "beaconing": 25,
              "encryption_anomaly": 20}
    return sum(list(counts.values())[:list(counts).index(name)])


@pytest.mark.parametrize("name", list(PATTERNS))
def test_recorded_means(scored, name):
    got = {r.model: r.mean for r in scored if r.scenario == name}
    order = ("xgboost", "lstm", "fft", "isolation_forest", "fused")
    assert [got[m] for m in order] == pytest.approx(EXPECTED[name], abs=1.01e-4)
    assert got["kitsune"] == 0.0


