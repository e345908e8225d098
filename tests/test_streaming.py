import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import T0, rows_of, traffic
from tapline.config import Config
from tapline.operators import behaviors, features, flows
from tapline.plans import detection, window_alerts
from tapline.session import scratch
from tapline.sources import events, tables
from tapline.streaming import alerts as stream_alerts
from tapline.streaming import detect, publish, run
from tapline.streaming import flows as stream_flows
from tapline.streaming import incidents as stream_incidents
from tapline.streaming import windows as stream_windows
from tapline.streaming.state import State

SF = "/root/testdata/sf0.001"


def _batches(spark, df, n, name):
    """Write a frame as n files in time order, read back one file per micro-batch."""
    path = scratch(spark, name)
    total = df.count()
    for i in range(n):
        (df.filter((F.col("event_id") >= i * total // n) & (F.col("event_id") < (i + 1) * total // n))
         .coalesce(1).write.mode("append").parquet(path))
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_signals_over_micro_batches_equal_batch(spark):
    t = tables.traffic(tables.events(spark, SF)).drop("metadata")
    base = scratch(spark, "sig")
    writer = detect.signals_writer(_batches(spark, t, 5, "in"), f"{base}/state",
                                   lambda d, i: d.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
    run.drain_writer(writer, f"{base}/checkpoint")
    got = spark.read.parquet(f"{base}/out").drop("batch")
    assert rows_of(got) == rows_of(detection.signals(t).select(got.columns))


def test_late_rows_equal_batch(spark):
    t = tables.traffic(tables.events(spark, SF)).drop("metadata")
    late = 6_000_000
    arrival = t.withColumn("_at", F.col("ts_us") + F.pmod(F.xxhash64("event_id"), F.lit(late)))
    edges = [r[0] for r in arrival.selectExpr("percentile_approx(_at, array(0.25, 0.5, 0.75)) AS q").selectExpr("explode(q)").collect()]
    state, got, low = scratch(spark, "late"), [], None
    for i, high in enumerate([*edges, None]):
        part = arrival if low is None else arrival.filter(F.col("_at") > low)
        part = part if high is None else part.filter(F.col("_at") <= high)
        got += rows_of(detect.behaviour_batch(part.drop("_at"), state, i, lateness_us=late).select("category", "event_id", "src_ip", "score"))
        low = high
    got += rows_of(detect.flush(spark, t.schema, state, 4, late).select("category", "event_id", "src_ip", "score"))
    assert sorted(got) == sorted(rows_of(behaviors.behavioural_signals(t).select("category", "event_id", "src_ip", "score")))


def _collected(spark, writer_of, flush_of, name, flushes=1):
    """Rows written per micro-batch and by the flush, by batch number."""
    base, found = scratch(spark, name), {}

    def sink(df, i):
        df.write.mode("overwrite").parquet(f"{base}/out/batch={i}")
        found[i] = f"{base}/out/batch={i}"

    run.drain_writer(writer_of(f"{base}/state", sink), f"{base}/checkpoint")
    last = max(found) + 1
    for _ in range(flushes):  # a repeated flush gives the same rows
        sink(flush_of(f"{base}/state", last), last)
    return {i: spark.read.parquet(p) for i, p in found.items()}


def _union(parts):
    out, *rest = parts.values()
    for p in rest:
        out = out.unionByName(p)
    return out


def test_flows_over_micro_batches_equal_batch(spark):
    c = tables.conversations_traffic(tables.events(spark, SF))
    parts = _collected(spark, lambda state, sink: stream_flows.flows_writer(_batches(spark, c, 4, "flows-in"), state, sink),
                       lambda state, i: stream_flows.flush(spark, c.schema, state, i), "flows", 2)
    batch = flows.flow_sessions(c)
    got = parts.copy()
    flushed = got.pop(max(got))
    newest = c.agg(F.max("ts_us")).first()[0]
    cols = ["src_ip", "dst_ip", "start_us", "last_us", "fwd_packets", "bwd_bytes", "tcp_state"]
    mine, all_ = set(rows_of(_union(got).select(cols))), set(rows_of(batch.select(cols)))
    assert mine <= all_
    settled = batch.filter(F.col("last_us") + 60_000_000 < newest - 7_000_000)
    assert set(rows_of(settled.select(cols))) <= mine and len(mine) > 40
    whole = _union(got).unionByName(flushed)
    assert rows_of(whole) == rows_of(batch.select(whole.columns))  # every column of every flow


def test_flows_cut_at_awkward_places(spark):
    """Resets, age limits, idle gaps and one dense pair; every packet may be the first of a micro-batch."""
    rows = [{"at": i * 2.5, "tcp_flags": "R" if i % 41 == 40 else ["S", "SA", "A", "PA"][i % 4], "src_port": 5, "dst_port": 6} for i in range(300)]
    rows += [{"at": 100 + i * 0.01, "src_ip": "10.0.0.9", "tcp_flags": ["A", "", None, "R"][i % 4], "packet_len": i} for i in range(500)]
    rows += [{"at": 60.0 * i, "src_ip": "10.0.0.7", "protocol": "UDP"} for i in range(9)] + [{"at": 541.0, "src_ip": "10.0.0.7", "protocol": "UDP"}]
    t = traffic(spark, sorted(rows, key=lambda r: r["at"])).drop("metadata")
    for parts, late in ((4, 4_000_000),):
        stream = tables.arriving(t, scratch(spark, "cuts"), parts, late, 2)
        cfg = Config(flow_slice_us=1_000_000)  # the batch below keeps its slices of five seconds
        got = _union(_collected(spark, lambda state, sink, stream=stream: stream_flows.flows_writer(stream, state, sink, cfg),
                                lambda state, i: stream_flows.flush(spark, t.schema, state, i, cfg), "cut-flows"))
        assert rows_of(got) == rows_of(flows.flow_sessions(t).select(got.columns))


def test_state_of_a_dense_pair_is_small(spark):
    t = traffic(spark, [{"at": i * 0.001} for i in range(8_000)]).drop("metadata")
    base = scratch(spark, "dense")
    stream_flows.flow_batch(t, base, 0, lateness_us=0)
    assert spark.read.parquet(f"{base}/open/batch=0").count() <= 9


def test_window_alerts_over_micro_batches_equal_batch(spark):
    t = tables.flagged(tables.batch_traffic(spark, SF, jitter=True)).drop("metadata")
    stream = tables.arriving(t, scratch(spark, "alerts-in"), 2, late_us=5_000_000)
    parts = _collected(spark, lambda state, sink: stream_alerts.alerts_writer(stream, state, sink),
                       lambda state, i: stream_alerts.flush(spark, t.schema, state, i), "alerts")
    batch = window_alerts.window_alerts(window_alerts.assessed_windows(t))
    got = _union(parts)
    flat = ["alert_id", "ts_us", "src_ip", "risk_score", "risk_level", "persistent", "feature_values.*", "model_disagreement", "confidence"]
    assert rows_of(got.select(flat)) == rows_of(batch.select(flat)) and got.count() >= 10
    assert len([p for p in parts.values() if p.count()]) > 1  # alerts come while the stream runs


def test_every_feature_of_closed_windows_equals_batch(spark):
    cfg = Config(fft_array_limit=250)  # windows with a slot of more than five events go beyond the array bound
    dense = traffic(spark, [{"at": 1.01 + i * 0.004 + (i % 7) * 0.0003, "dst_port": i % 9, "ttl": 60 + i % 3} for i in range(400)]
                    + [{"at": 3 + i * 0.31, "src_ip": f"10.0.1.{i % 4}", "protocol": "UDP"} for i in range(60)]).drop("metadata")
    dense = dense.withColumn("event_id", F.row_number().over(Window.orderBy("ts_us", "event_id")).cast("long"))
    base = scratch(spark, "closed")
    edges, got = [-1, 170, 300, 430, 460], []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = dense.filter((F.col("event_id") > low) & (F.col("event_id") <= high))
        got += rows_of(stream_alerts.closed_features(part, State(spark, base, i), cfg, lateness_us=500_000)[0])
    tail, _ = stream_alerts.closed_features(dense.limit(0), State(spark, base, 4), cfg, lateness_us=500_000, flush=True, emit_partial=True)
    batch = features.window_features(dense, cfg, emit_partial=True)
    assert sorted(got + rows_of(tail), key=str) == rows_of(batch.select([f"`{c}`" for c in tail.columns]))


def test_rows_behind_the_watermark_are_dropped_and_counted(spark):
    t = traffic(spark, [{"at": 1}, {"at": 20}, {"at": 2}, {"at": 15}, {"at": 40}]).drop("metadata")
    base = scratch(spark, "behind")
    parts = [t.filter(F.col("event_id") < 2), t.filter((F.col("event_id") >= 2) & (F.col("event_id") < 4)), t.filter("event_id = 4")]
    ends = [stream_alerts.closed_features(p, State(spark, base, i))[0].select("window_end", "packets").collect() for i, p in enumerate(parts)]
    assert [[(r.window_end - T0) // 1_000_000 for r in e] for e in ends] == [[1, 2, 3, 4, 5], [], [15, 16, 17, 18, 19, 20, 21, 22, 23, 24]]
    assert spark.read.parquet(f"{base}/clock/batch=2").first().late == 1  # the packet at 15 s is later than six seconds but not behind


def test_incidents_and_boundary(spark):
    rows = [{"at": 0}, {"at": 10}, {"at": 20.000001}, {"at": 60}]
    s = traffic(spark, rows).select("event_id", "timestamp", "ts_us", "src_ip", "dst_ip", F.lit("X").alias("category"),
                                    F.lit("HIGH").alias("severity"), F.lit("m").alias("detection_method"))
    got = run.drain(stream_incidents.incidents(_batches(spark, s, 1, "inc-in")), "inc").orderBy("first_us").collect()
    assert [(r.first_us - T0, r.event_count) for r in got] == [(0, 2), (20_000_001, 1)]


def test_jsonl_stream_windows_health_and_fanout(spark, tmp_path):
    for b in range(2):
        lines = [json.dumps({"timestamp": f"2024-01-01T00:00:{b * 20 + i:02d}Z", "packet_len": 10}) for i in range(20)]
        (tmp_path / f"{b}.jsonl").write_text("\n".join([*lines, "{bad"]))
    health = run.watch(spark)
    df = run.observed(events.stream_jsonl(spark, str(tmp_path)))
    out = run.drain(stream_windows.volumes(df), "vol").orderBy("window_end").collect()
    assert [r.packets for r in out[:6]] == [1, 2, 3, 4, 5, 5]
    assert (out[0].window_end - T0) == 0 and len(out) == 33

    seen = []
    base = scratch(spark, "fan")

    def broken(_):
        raise RuntimeError("subscriber")

    writer = detect.fan_out(events.stream_jsonl(spark, str(tmp_path)).drop("metadata"), base, {
        "raw": lambda d: d, "count": lambda d: d.groupBy("protocol").count()}, [broken, lambda d: seen.append(d.count())])
    run.drain_writer(writer, f"{base}/checkpoint")
    assert spark.read.parquet(f"{base}/raw").count() == 40 and sum(seen) == 40
    spark.streams.removeListener(health)
    assert health.packets == 40


def test_late_and_repeated_events(spark):
    rows = [{"at": 0}, {"at": 20}, {"at": 20}, {"at": 1}, {"at": 40}]
    stream = _batches(spark, traffic(spark, rows).drop("metadata"), 5, "late-in")
    got = run.drain(stream_windows.dedup(stream).select("ts_us"), "dedup")
    # The repetition is dropped, and so is the event nineteen seconds behind the newest.
    assert sorted((r.ts_us - T0) // 1_000_000 for r in got.collect()) == [0, 20, 40]


def test_behaviours_do_not_read_past_the_carry(spark):
    t = traffic(spark, [{"at": i * 0.05, "dst_port": i + 1} for i in range(60)])
    base = scratch(spark, "carry")
    sizes = []
    for b in range(3):
        part = t.filter((F.col("event_id") >= b * 20) & (F.col("event_id") < (b + 1) * 20))
        sizes.append(detect.behaviour_batch(part, base, b).count())
    assert sum(sizes) == behaviors.behavioural_signals(t).count() == 41


def test_published_batches_are_whole_and_told_once(spark):
    path, heard = scratch(spark, "published"), []
    t = traffic(spark, [{"at": i, "protocol": "UDP" if i % 2 else "TCP"} for i in range(10)]).drop("metadata")
    parts = [t.filter(F.col("event_id") < 5), t.filter(F.col("event_id") >= 5)]
    views = {"raw": lambda d: d, "count": lambda d: d.groupBy("protocol").count()}
    troubled = {"left": 1}

    def once_broken(batch):
        if troubled["left"]:
            troubled["left"] -= 1
            raise RuntimeError("subscriber")
        heard.append(("late", batch.count()))

    subscribers = {"seen": lambda d: heard.append(("seen", d.count())), "late": once_broken}
    publish.publish(parts[0], 0, path, views, subscribers)
    assert heard == [("seen", 5)]
    publish.publish(parts[0], 0, path, views, subscribers)  # the batch repeats: only the one that failed hears of it again
    assert heard == [("seen", 5), ("late", 5)]

    def broken(d):
        raise RuntimeError("table")

    for _ in range(2):
        try:
            publish.publish(parts[1], 1, path, {**views, "zz": broken}, subscribers)
        except RuntimeError:
            pass
    assert publish.committed(spark, path) == [0] and len(heard) == 2
    assert publish.published(spark, path, "raw").count() == 5  # what the failed batch wrote is not seen
    publish.publish(parts[1], 1, path, views, subscribers)
    assert publish.published(spark, path, "raw").count() == 10 and heard[2:] == [("seen", 5), ("late", 5)]
    assert {(r.protocol, r["count"]) for r in publish.published(spark, path, "count").collect()} == {("TCP", 3), ("UDP", 2), ("TCP", 2), ("UDP", 3)}
