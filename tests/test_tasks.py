"""Tasks whose number follows the events, with results that do not depend on it."""

import json

from pyspark.sql import functions as F

from tapline.config import Config
from tapline.operators import behaviors, features, windows
from tapline.session import tasks_for
from tapline.sources import captures, files
from tests.helpers import rows_of, traffic


def mixed(spark, n=600):
    return traffic(spark, [{
        "at": i * 0.07 + (i // 200) * 40, "src_ip": f"10.0.0.{i % 3}" if i % 7 else None, "dst_ip": f"10.0.1.{i % 17}", "dst_port": i % 29,
        "src_port": i % 5, "ttl": 60 + i % 2, "ip_id": i % 11, "tcp_flags": ["S", "R", None][i % 3]} for i in range(n)])


def test_tasks_follow_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark.range(10 * cores + 1), 10) == cores + 1 and tasks_for(spark.range(0), 10) == cores


def test_window_parts_do_not_depend_on_tasks(spark):
    cfg, df = Config(), mixed(spark)
    assert rows_of(windows.value_counts(df, cfg, tasks=13)) == rows_of(windows.value_counts(df, cfg))
    by = ("src_ip",)
    assert rows_of(windows.value_counts(df, cfg, by, tasks=13)) == rows_of(windows.value_counts(df, cfg, by))
    plain = lambda f: rows_of(f.withColumns({c: F.to_json(c) for c in ("len_m", "iat_m", "head", "tail")}))
    for keys in ((), by):
        slots = windows.slots(df, cfg, keys, times=True)
        assert plain(features.combine_slots(windows.slots(df, cfg, keys, times=True, tasks=13), cfg, keys, times=True, tasks=13)) == plain(
            features.combine_slots(slots, cfg, keys, times=True))


def test_counts_are_shared_by_as_many_tasks_as_asked(spark, monkeypatch):
    df = mixed(spark)
    slotted = Config(behaviour_slot_us=1_000_000)
    want = [rows_of(behaviors.behaviour_counts(df, c, ("scan", "sweep", "rst"))) for c in (Config(), slotted)]
    monkeypatch.setattr(behaviors, "tasks_for", lambda rows: 37)
    for cfg, parts, expected in ((Config(), 37, want[0]), (slotted, 4 * 37, want[1])):
        got = behaviors.behaviour_counts(df, cfg, ("scan", "sweep", "rst"))
        assert rows_of(got) == expected and got.rdd.getNumPartitions() == parts
    assert windows.value_counts(df, tasks=37).rdd.getNumPartitions() == 37


def test_export_totals_run_over_chunks_of_lines(spark, tmp_path, monkeypatch):
    docs = [{"_source": {"layers": {"frame.time_epoch": [f"{1718000000 + i}.5"], "ip.src": [f"10.0.0.{i % 9}"], "frame.len": [str(i)]}}} for i in range(60)]
    (tmp_path / "x.json").write_text(json.dumps(docs, indent=1))
    monkeypatch.setattr(files, "CHUNK_LINES", 16)
    got = captures.read_tshark_json(spark, str(tmp_path / "x.json"))
    assert sorted(r.packet_len for r in got.collect()) == list(range(60))


def test_value_counts_are_summed_by_hash(spark, capsys):
    counts = windows.value_counts(mixed(spark), fields=features.COUNTED, tasks=13)
    features.value_sums(counts).explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "seen" not in counts.columns  # only protocols carry their order of appearance


def test_windows_are_put_together_in_as_many_tasks_as_asked(spark, monkeypatch):
    """Not in one that Spark makes of them all, and with the sums that undivided counts have."""
    df = mixed(spark)
    want = rows_of(features.value_sums(windows.value_counts(df, fields=features.COUNTED)))
    counts = windows.value_counts(df, fields=features.COUNTED, tasks=37, parts=True)
    assert rows_of(features.value_sums(counts, tasks=37)) == want
    protocols = windows.value_counts(df, fields=["proto"], tasks=37)
    assert features.value_features(counts, protocols, tasks=37).rdd.getNumPartitions() == 37
    monkeypatch.setattr(features, "tasks_for", lambda rows: 37)
    assert features.window_features(df, spectral=False).rdd.getNumPartitions() == 37


def test_dominant_protocol_of_windows(spark):
    """Most events, then the earliest, and windows without any protocol."""
    df = traffic(spark, [{"at": 0.1 + 0.1 * i, "protocol": p} for i, p in enumerate(["udp", "TCP", "tcp", "UDP", "icmp"])] + [
        {"at": 30.0, "protocol": None}, {"at": 31.0, "protocol": None}])
    got = {r.protocol: r for r in features.window_features(df, emit_partial=True, spectral=False).collect()}
    assert set(got) == {"UDP", None}
