import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tapline.functions import metadata as md
from tapline.plans import catalog
from tapline.sources import captures, events, files, labelled, sinks, tables
from tapline.sources.keyed import KeyedTable


def test_jsonl(spark, tmp_path):
    good = {"timestamp": "2024-01-01T00:00:00Z", "src_ip": "10.0.0.1", "dst_port": "502", "packet_len": 64.0,
            "metadata": {"spoofed": True}}
    lines = [json.dumps(good), "", "{oops", "[1,2]", json.dumps({**good, "packet_len": 1.5}),
             json.dumps({**good, "src_ip": None}), json.dumps({**good, "src_port": None}),
             json.dumps({**good, "src_ip": 5}), json.dumps({"timestamp": 1704067200.25}),
             json.dumps({"timestamp": 1704067200250}), json.dumps({**good, "timestamp": "soon"}),
             json.dumps({**good, "metadata": [1]}), json.dumps({**good, "unknown": 1})]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    rows = events.read_jsonl(spark, str(tmp_path / "e.jsonl"))
    got = rows.withColumn("sp", md.spoofed(F.col("metadata"), F.col("src_ip"))).orderBy("ts_us", "src_ip").collect()
    assert [r.ts_us % 1_000_000 for r in got] == [0, 0, 0, 250000, 250000]
    assert (got[0].dst_port, got[0].packet_len, got[0].protocol, got[0].sp) == (502, 64, "TCP", True)
    assert (got[3].src_ip, got[3].data_source, got[3].src_port) == ("0.0.0.0", "live_capture", None)


def test_tshark_row_and_export(spark, tmp_path):
    row = {"frame.time_epoch": "1718000111.25", "ip.src": "172.20.5.9", "ip.dst": "172.20.7.31", "frame.len": "211",
           "ip.checksum.status": "Bad", "tcp.payload": "0a1b2c"}
    docs = [{"_source": {"layers": {**row, "tcp.srcport": ["40117", "9"], "_ws.col.Protocol": ["MODBUS"]}}}, row]
    (tmp_path / "x.json").write_text(json.dumps(docs, indent=1))
    got = captures.read_tshark_json(spark, str(tmp_path / "x.json")).orderBy("protocol").collect()
    assert [(r.protocol, r.src_port, r.packet_len) for r in got] == [("MODBUS", 40117, 211), ("TCP", None, 211)]
    for r in got:
        doc = json.loads(r.metadata.toJson())
        assert doc["checksum_valid"] is False and "tcp.payload" not in doc


def test_tshark_field_lines(spark, tmp_path):
    lines = ["1704067200.5\t10.0.0.1\t10.0.0.2\t1\t2\t\t\tTCP\t60\t64\t7\t\t", "\t10.0.0.1\t10.0.0.2", "1\t\tx",
             "1704067201\t10.0.0.1\t10.0.0.2\t\t\t53\t53\tDNS\t80"]
    (tmp_path / "f.tsv").write_text("\n".join(lines) + "\n")
    got = captures.read_tshark_fields(spark, str(tmp_path / "f.tsv")).orderBy("ts_us").collect()
    assert [(r.dst_port, r.protocol, r.ttl, r.data_source) for r in got] == [
        (2, "TCP", 64, "tshark_live"), (53, "DNS", None, "tshark_live")]
    assert got[0].ts_us == 1_704_067_200_500_000


def test_zeek_header_and_defaults(spark, tmp_path):
    head = "#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tduration\torig_bytes\tresp_bytes\n"
    body = ("1718000111.25\tCq7\t172.20.5.9\t40117\t172.20.7.31\t20000\ttcp\tdnp3\t0.4\t113\t98\n#close\n"
            "1718000112\tCq8\ta\t0\tb\t-\tudp\t-\t-\t-\t5\n")
    (tmp_path / "conn.log").write_text("#separator x\n" + head + body)
    (tmp_path / "bare.log").write_text(body)
    for name in ("conn.log", "bare.log"):
        got = captures.read_zeek(spark, str(tmp_path / name)).orderBy("ts_us").collect()
        assert [(r.packet_len, r.src_port, r.dst_port) for r in got] == [(211, 40117, 20000), (5, None, None)]


def test_zeek_folder_reads_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.log").write_text("#fields\tts\tuid\tid.orig_h\tproto\n1718000111\tU1\t172.20.5.9\ttcp\n")
    (tmp_path / "b.log").write_text("#fields\tproto\tid.orig_h\tts\nudp\t172.20.5.8\t1718000112\n")
    got = captures.read_zeek(spark, str(tmp_path)).orderBy("ts_us").collect()
    assert [(r.src_ip, r.protocol, json.loads(r.metadata.toJson())["uid"]) for r in got] == [
        ("172.20.5.9", "tcp", "U1"), ("172.20.5.8", "udp", "")]


def test_indicator_feed(spark, tmp_path):
    (tmp_path / "feed.txt").write_text("# head\n1.2.3.4\n\n  5.6.7.8 \n1.2.3.4\n")
    got = sorted(r.indicator for r in events.read_indicators(spark, str(tmp_path / "feed.txt")).collect())
    assert got == ["1.2.3.4", "5.6.7.8"]


def _csv(path, rows, bom=""):
    path.write_text(bom + "timestamp,group,feature_a,feature_b,label\n" + "\n".join(rows), encoding="utf-8")


def test_labelled_contract(spark, tmp_path):
    rows = [f"2026-01-01T00:{i:02d}:00Z,host-{i % 6},{i / 10},{'True' if i % 2 else 'f'},{int(i >= 15)}" for i in range(30)]
    p = tmp_path / "d.csv"
    _csv(p, rows, "﻿")
    digest = hashlib.sha256(p.read_bytes()).hexdigest()
    c = labelled.Contract(timestamp="timestamp", group="group", sha256=digest)
    df, cols = labelled.read_labelled(spark, str(p), c)
    assert cols == ["feature_a", "feature_b"] and df.count() == 30
    assert df.filter("feature_b = 1.0").count() == 15
    assert [r.label for r in df.orderBy("row_id").collect()] == [0] * 15 + [1] * 15
    with pytest.raises(labelled.ContractError, match="checksum"):
        labelled.read_labelled(spark, str(p), labelled.Contract(sha256="0" * 64))
    with pytest.raises(labelled.ContractError, match="absent"):
        labelled.read_labelled(spark, str(p), labelled.Contract(features=("missing",)))
    for i, bad in enumerate(["x,g,1,f,2", "x,g,1,f,y", "x,g,inf,f,1", "x,g,oops,f,1"]):
        q = tmp_path / f"bad{i}.csv"
        _csv(q, [*rows, bad])
        with pytest.raises(labelled.ContractError):
            labelled.read_labelled(spark, str(q), labelled.Contract(timestamp="timestamp", group="group"))
    short = tmp_path / "short.csv"
    _csv(short, rows[:10])
    with pytest.raises(labelled.ContractError, match="20 rows"):
        labelled.read_labelled(spark, str(short), labelled.Contract(timestamp="timestamp", group="group"))


def test_json_rewrite(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"a": 1}\n\n{"b":  [1, 2]}\n')
    labelled.rewrite_jsonl(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":1}', '{"b":[1,2]}']


def test_upsert_and_additive_schema(spark, tmp_path):
    path = str(tmp_path / "assets")
    sinks.upsert(spark.createDataFrame([("a", "h1"), ("b", "h2")], "asset_id string, hostname string"), path, 1)
    sinks.upsert(spark.createDataFrame([("a", "h3", 0.9)], "asset_id string, hostname string, criticality double"), path, 2)
    got = [tuple(r) for r in sinks.read_latest(spark, path, "asset_id").select("asset_id", "hostname", "criticality").collect()]
    assert got == [("a", "h3", 0.9), ("b", "h2", None)]


def test_repeated_batch_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(1_704_067_200_000_000, 1)], "ts_us long, v int")
    for _ in range(2):
        sinks.save_flows(df, str(tmp_path), batch_id=3)
    assert sinks.read(spark, str(tmp_path / "flows")).count() == 1


def test_feedback_domain(spark):
    df = spark.createDataFrame([("1", "BENIGN", None), ("2", "maybe", "c"), ("3", None, "c")],
                               "alert_id string, label string, comment string")
    good, bad = sinks.feedback(df)
    assert [r.alert_id for r in good.collect()] == ["1"] and bad.count() == 2 and good.first().comment == ""


def test_model_registry_and_report(spark, tmp_path):
    path = str(tmp_path / "models")
    for v, f1 in ((1, 0.1), (2, 0.2)):
        sinks.upsert(sinks.model_version_rows(spark, [{"model_name": "fft", "metrics": {"f1": f1}}]), path, v)
    row = sinks.read_latest(spark, path, "model_name").first()
    assert json.loads(row.metrics) == {"f1": 0.2}
    sinks.write_report(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().n == 1


def test_digests_equal_the_files(spark, tmp_path):
    cases = {"a b.csv": b"x,y\n1,2\n", "b+c.csv": b"x,y\r\n1,2", "d%20e.csv": b"\xef\xbb\xbfx\n\n\ny\n", "e.csv": b"\n",
             "f.bin": b"\xff\xfe\x00\nq" + b"z" * 100_000 + b"\n\n", "g.csv": b"".join(b"%d,row\n" % i for i in range(20_000))}
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits a file
    try:
        assert files.lines(spark, str(tmp_path / "g.csv")).rdd.getNumPartitions() > 3
        got = {os.path.basename(r.path): (r.bytes, r.sha256) for r in files.digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in cases.items()}


def test_json_elements_in_every_layout(spark, tmp_path):
    docs = [{"i": i, "_source": {"layers": {"ip.src": ["10.0.0.1"], "x": '}{][\\" \\\\', "n": [[1], {"a": [None]}]}}} for i in range(400)]
    layouts = {"pretty": json.dumps(docs, indent=2), "one": json.dumps(docs), "lines": "\n".join(map(json.dumps, docs)),
               "rows": "[\n" + ",\n".join(map(json.dumps, docs)) + "\n]\n", "tabs": "\n\n" + json.dumps(docs, indent="\t") + "\n",
               "single": json.dumps(docs[0], indent=1), "none": "[]",
               "odd": '[\n{"i":\n1},{"i":2}\n,\n{"i":3,"q":[{},\n{}]}]'}
    for name, text in layouts.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {n: sorted(json.loads(r[0])["i"] for r in files.json_elements(spark, str(tmp_path / n)).select(F.to_json("element")).collect())
               for n in layouts}
        assert files.lines(spark, str(tmp_path / "pretty")).rdd.getNumPartitions() > 3
        whole = [json.loads(r[0]) for r in files.json_elements(spark, str(tmp_path / "pretty")).select(F.to_json("element")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    every = list(range(400))
    assert got == {"pretty": every, "one": every, "lines": every, "rows": every, "tabs": every, "single": [0], "none": [], "odd": [1, 2, 3]}
    assert sorted(whole, key=lambda d: d["i"]) == docs


def test_keyed_table_merges_by_bucket(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", 4)

    def rows(*data):
        return spark.createDataFrame(data, "id string, v int, m map<string,int>")

    def stored(version=None):
        return sorted(((r.id, r.v) for r in table.read(version).collect()), key=str)

    assert table.read() is None
    table.merge(rows(("a", 1, {"x": 1}), ("b", 1, None), ("a", 0, None)), 1, "v")
    table.merge(rows(("a", 5, None), ("c", 2, None), (None, 7, None)), 2, "v")
    for _ in range(2):  # a repeated merge replaces itself, an older value does not win
        table.merge(rows(("a", 4, None)), 3, "v")
    assert stored() == [("a", 5), ("b", 1), ("c", 2), (None, 7)] and stored(1) == [("a", 1), ("b", 1)]
    bad = spark.createDataFrame([("b", 9)], "id string, v int").withColumn("v", F.expr("IF(v = 9, raise_error('lost'), v)").cast("int"))
    try:
        table.merge(bad, 4, "v")
        raise AssertionError("the merge must fail")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert table.versions() == [1, 2, 3] and stored() == [("a", 5), ("b", 1), ("c", 2), (None, 7)]
    table.merge(rows(("b", 0, None)).withColumn("more", F.lit("x")), 5)  # without an order the new row wins; columns may grow
    assert stored()[1] == ("b", 0) and {r.more for r in table.read().collect()} == {"x", None}
    table.vacuum()
    assert table.versions() == [5] and stored()[1] == ("b", 0)
    table.merge(rows(), 6)
    assert len(stored()) == 4


def test_tshark_fields_sum_past_64_bits(spark, tmp_path):
    """One source with more lines than a 64-bit sum of microseconds holds."""
    rows = spark.range(8000).select(F.expr("id div 399 * 2000 + id % 399 + 1").alias("event_id"), F.lit(0).cast("bigint").alias("user_id"),
                                    F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 2}').alias("props"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["tshark_fields"](spark, str(tmp_path)).collect()
    ids = [i // 399 * 2000 + i % 399 + 1 for i in range(8000)]
    want = sum(tables.BASE_US + i * tables.STEP_US for i in ids if i % 20)
    assert want > 1 << 63 and [(r.src_ip, r.times) for r in got] == [("10.0.0.1", str(want))]
