import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import T0, rows_of, traffic
from tapline.config import Config
from tapline.operators import bigfft, extractor, features, flows, persistence, scoring, spectral
from tapline.plans import window_alerts
from tapline.sources import tables


def test_two_way_flow(spark):
    t = traffic(spark, [
        {"at": 0, "src_port": 50000, "dst_port": 80, "tcp_flags": "S"},
        {"at": 1, "src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "src_port": 80, "dst_port": 50000, "packet_len": 200,
         "tcp_flags": "SA"}])
    f = flows.flow_sessions(t).first()
    assert (f.src_ip, f.fwd_packets, f.bwd_packets, f.total_bytes, f.tcp_state) == ("10.0.0.1", 1, 1, 300, "SYN_RCVD")
    assert f.inter_arrival_times == [0.0, 1.0] and f.bwd_lengths == [200]


def test_idle_reset_and_age_split(spark):
    t = traffic(spark, [{"at": 0, "tcp_flags": "A"}, {"at": 60, "tcp_flags": "R"}, {"at": 61, "tcp_flags": "A"},
                        {"at": 121.5, "tcp_flags": "A"}], src_port=1, dst_port=2)
    assert [r.total_packets for r in flows.flow_sessions(t).orderBy("start_us").collect()] == [2, 1, 1]
    long = traffic(spark, [{"at": 2 + i * 10} for i in range(70)], src_port=1, dst_port=2)
    got = [(r.start_us - T0, r.total_packets) for r in flows.flow_sessions(long).orderBy("start_us").collect()]
    # Started in sweep interval 0, so the sweep at 305 s ends the first session.
    assert got == [(2_000_000, 31), (312_000_000, 31), (622_000_000, 8)]


def test_hot_flow_reduces_to_fragments(spark):
    t = traffic(spark, [{"at": i * 0.01} for i in range(3000)], src_port=1, dst_port=2)
    assert flows.fragments(t).count() == 6
    f = flows.flow_sessions(t).first()
    assert f.total_packets == 3000 and len(f.inter_arrival_times) == 100 and len(f.fwd_lengths) == 50


def _whole(spark, rows, **kw):
    t = tables.flagged(traffic(spark, rows, **kw)).withColumn("g", F.lit("x"))
    return features.window_features(t, group_cols=("g",), whole=True).first()


def test_feature_fixtures(spark):
    f = _whole(spark, [{"at": i} for i in range(5)])
    assert f.packets == 5 and f.iat_mean == 1.0 and f.iat_skewness == 0.0
    assert set(features.FEATURES) <= set(f.asDict())
    u = _whole(spark, [{"at": i} for i in range(5)], protocol="UDP", dst_port=19001)
    assert u.udp_ratio == 1.0 and u.udp_burst_score > 0
    a = _whole(spark, [{"at": i, "ttl": 32 + i, "meta": '{"payload_altered":true}' if i == 2 else "{}"} for i in range(5)])
    assert (a.ttl_anomaly_score, a.payload_integrity_anomaly) == (1.0, 0.2)
    s = _whole(spark, [{"at": i} for i in range(8)], src_ip="10.0.0.7",
               meta='{"observed_socket_src_ip":"10.0.0.99","payload_sha256":"bad","expected_payload_sha256":"good"}')
    assert (s.ip_spoofing_score, s.packet_alteration_score) == (1.0, 1.0)


def test_extractor_fixture(spark):
    rows = [{"at": 0, "dst_port": 80, "packet_len": 100, "tcp_flags": "S"},
            {"at": 0, "dst_port": 443, "packet_len": 200, "tcp_flags": "A"},
            {"at": 0, "dst_port": 53, "packet_len": 80, "protocol": "UDP"}]
    x = extractor.extract(traffic(spark, rows).withColumn("g", F.lit(1)), group_cols=("g",), whole=True, presented=True).first()
    assert (x.packets, x.bytes, x.unique_dst_ports, x.tcp_ratio, x.udp_ratio) == (3, 380, 3, 0.6667, 0.3333)
    assert x.port_entropy > 0 and x.protocol == "MIXED"


def test_window_membership_excludes_the_start(spark):
    t = traffic(spark, [{"at": 0}, {"at": 1}, {"at": 5}, {"at": 6}])
    got = {(r.window_end - T0) // 1_000_000: r.packets for r in features.window_features(t, spectral=False).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2}


@pytest.mark.parametrize("slot", [50_000, 500_000, 1_000_000])
def test_slot_length_does_not_matter(spark, slot):
    ev = tables.events(spark, "/root/testdata/sf0.001")
    t = tables.flagged(tables.traffic(ev, jitter=True))
    cols = ["window_end", "packets", "iat_mean", "iat_std", "iat_skewness", "iat_kurtosis", "packet_len_std", "flow_count"]
    a = features.window_features(t, spectral=False).select(cols)
    b = features.window_features(t.repartition(7), Config(slot_us=slot), spectral=False).select(cols)
    for x, y in zip(sorted(a.collect()), sorted(b.collect())):
        assert list(x) == pytest.approx(list(y), rel=1e-9, abs=1e-9)


def test_distributed_transform_equals_numpy(spark):
    rng = np.random.default_rng(3)
    data, expect = [], {}
    for name, n in (("a", 97), ("b", 64), ("c", 1000), ("d", 5)):
        x = rng.normal(size=n)
        expect[name] = np.abs(np.fft.rfft(x))[1:]
        data += [(name, n, j, float(v)) for j, v in enumerate(x)]
    got = bigfft.magnitudes(spark.createDataFrame(data, "w string, n long, j long, x double")).toPandas()
    for name, mags in expect.items():
        mine = got[got.w == name].sort_values("k").magnitude.to_numpy()
        assert mine == pytest.approx(mags, abs=1e-9)


def test_oversized_windows_take_the_distributed_transform(spark):
    t = tables.flagged(tables.traffic(tables.events(spark, "/root/testdata/sf0.001"), jitter=True)).filter("event_id < 160")
    cols = ["window_end", *spectral.SPECTRAL]
    a = features.window_features(t).select(cols).collect()
    # Two events per slot are allowed, so busy slots push their windows over the bound.
    b = features.window_features(t, Config(fft_array_limit=100)).select(cols).collect()
    for x, y in zip(sorted(a), sorted(b)):
        assert list(x) == pytest.approx(list(y), abs=1e-7)


@pytest.mark.parametrize("whole", [False, True])
def test_both_transforms_agree_on_even_and_uneven_gaps(spark, whole):
    even = [{"at": 0.05 + 0.07 * i} for i in range(60)]
    uneven = [{"at": 20.05 + 0.07 * i + 0.01 * (i * i % 5)} for i in range(60)]
    t = tables.flagged(traffic(spark, even + ([] if whole else uneven)).withColumn("asset_id", F.lit("a")))
    cols = ["window_end", *spectral.SPECTRAL]
    a, b = (sorted(features.window_features(t, Config(fft_array_limit=n), whole=whole, emit_partial=True).select(cols).collect())
            for n in (1 << 20, 50))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert list(x) == pytest.approx(list(y), abs=1e-7) and None not in y


def test_empty_windows(spark):
    t = traffic(spark, [{"at": 0.5}, {"at": 20.5}])
    f = features.with_empty_windows(features.window_features(t, spectral=False, emit_partial=True))
    got = sorted(((r.window_end - T0) // 1_000_000, r.empty_window) for r in f.collect())
    assert [e for e, z in got if z] == list(range(6, 21)) and [e for e, _ in got] == list(range(1, 26))


def test_fusion_and_risk(spark):
    df = spark.sql("SELECT map('xgboost', 0.8D, 'fft', 0.2D) AS model_scores")
    r = scoring.fuse(df, Config(fusion_weights={"xgboost": 0.5, "fft": 0.5})).first().fusion
    assert r.score == pytest.approx(0.5) and r.variance == pytest.approx(0.09) and r.max_score == 0.8


def test_spoofed_window_alert(spark):
    t = tables.flagged(traffic(spark, [{"at": 0.1 + i, "meta": '{"virtual_identity":true}'} for i in range(12)]))
    cfg = Config(persistence_windows=1, cooldown_us=0, risk_warning=0.7, risk_info=0.3)
    a = window_alerts.window_alerts(window_alerts.assessed_windows(t, cfg, online=False), None, cfg)
    rows = a.collect()
    assert rows and {r.attack_category for r in rows} == {"IP_SPOOFING"}
    assert rows[0].top_features and rows[0].explanation.models["xgboost"].features


def test_persistence_and_cooldown(spark):
    ends = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 40, 41, 100]
    scores = [.6, .6, .2, .6, .6, .6, .6, .6, .6, .6, .6, .6, .6]
    df = spark.createDataFrame([("k", e * 1_000_000, s) for e, s in zip(ends, scores)],
                               "src_ip string, window_end long, risk_score double")
    run = {r.window_end // 1_000_000: r.consecutive for r in persistence.island_counts(df).collect()}
    assert run[2] == 2 and run[3] == 0 and run[10] == 7 and run[100] == 10
    hits = persistence.persistent_hits(df).filter("hit_run")
    emitted = sorted(r.window_end // 1_000_000 for r in persistence.cooldown(hits, cfg=Config(cooldown_us=3_000_000)).collect())
    assert emitted == [6, 9, 40, 100]
    thirty = sorted(r.window_end // 1_000_000 for r in persistence.cooldown(hits).collect())
    assert thirty == [6, 40, 100]


def test_results_do_not_depend_on_partitioning(spark):
    c = tables.conversations_traffic(tables.events(spark, "/root/testdata/sf0.001"))
    assert rows_of(flows.flow_sessions(c)) == rows_of(flows.flow_sessions(c.orderBy(F.desc("event_id")).repartition(5)))
