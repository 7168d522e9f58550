"""Readers and writers on small generated files."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from hosttrace.operators import clean
from hosttrace.plans import etl
from hosttrace.sources import logs, sinks, tables


def xml(record, event, time="2026-01-01T00:00:01.5Z", **fields):
    data = "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in fields.items())
    return (f"<Event><System><EventID Qualifiers='0'>{event}</EventID><TimeCreated SystemTime='{time}'/>"
            f"<EventRecordID>{record}</EventRecordID><Computer>w1</Computer></System><EventData>{data}</EventData></Event>")


def test_linux_log(spark, tmp_path):
    (tmp_path / "run_a.log").write_bytes(
        ("t1\t10.0.0.1\t" + xml(1, 1, UtcTime="2026-01-01 00:00:00.123", ProcessGuid="{a}", Image="/bin/sh",
                               CommandLine="a &lt; b &amp;quot;", User="-", ProcessId="7") + "\n"
         + xml(2, 99, ProcessGuid="{b}", ProcessGuid2="x") + "\nnoise\n"
         + "t3\th\t<EventID>255</EventID>\nt4\th\t<EventID>3</EventID><Data Name=\"DestinationPort\">443</Data>"
           "<Data Name=\"DestinationPort\">80</Data><Data Name=\"Image\"/>\xff\n").encode("latin-1"))
    rows = logs.parse_events(logs.read_linux_log(spark, str(tmp_path)), "linux").orderBy("EventID").collect()
    assert [(r.EventID, r.event_name, r.session) for r in rows] == [
        (1, "ProcessCreate", "run_a"), (3, "NetworkConnect", "run_a"), (99, "Unknown_99", "run_a")]
    a, c, b = rows
    assert (a.recv_timestamp, a.host_ip, a.CommandLine, a.User, a.ProcessId) == ("t1", "10.0.0.1", 'a < b "', None, 7)
    assert a.UtcTime.microsecond == 123000 and a.parent_known == 0 and a.computer == "w1"
    assert (b.recv_timestamp, b.host_ip) == (None, None) and c.DestinationPort == 80 and c.Image is None


def test_windows_log(spark, tmp_path):
    text = "\ufeff" + xml(1, 1, ProcessGuid="{a}", CommandLine="line1\nline2", ParentProcessGuid="{p}") + "\n" + xml(
        2, 13, TargetObject=r"HKLM\x") + "\n" + xml(3, 11, TargetFilename="t")[:-len("</EventData></Event>")]
    (tmp_path / "w.xml").write_text(text, encoding="utf-8")
    rows = logs.parse_events(logs.read_windows_log(spark, str(tmp_path)), "windows").orderBy("record_id").collect()
    assert [r.record_id for r in rows] == [1, 2, 3]
    assert rows[0].CommandLine == "line1\nline2" and rows[0].parent_known == 1
    assert rows[0].recv_timestamp == "2026-01-01T00:00:01.5Z" and rows[2].TargetFilename == "t"
    fields = logs.raw_fields(logs.read_windows_log(spark, str(tmp_path))).collect()
    assert ("CommandLine", "line1\nline2") in {(r.name, r.value) for r in fields}


def test_csv_and_public_subset(spark, tmp_path):
    (tmp_path / "r1_labeled.csv").write_text("EventID,ProcessGuid,label,UtcTime\n1,{a},1,2026-01-01 00:00:00\n3,,0,bad\n")
    with gzip.open(tmp_path / "r2_labeled.csv.gz", "wt") as f:
        f.write("label,EventID,Image,ProcessGuid\n0,5,/bin/x,{b}\n")
    paths = [str(tmp_path / "r1_labeled.csv"), str(tmp_path / "r2_labeled.csv.gz")]
    rows = tables.read_event_csv(spark, paths).orderBy("run_id", "EventID").collect()
    assert [(r.run_id, r.EventID, r.label, r.ProcessGuid) for r in rows] == [
        ("r1", 1, 1, "{a}"), ("r1", 3, 0, None), ("r2", 5, 0, "{b}")]
    assert rows[0].UtcTime is not None and rows[1].UtcTime is None and rows[2].Image == "/bin/x"
    public = tables.read_public_csv(spark, paths)
    assert public.columns == [*tables.PUBLIC_COLUMNS, "run_id", "record_id", "platform"] and public.where("Device IS NOT NULL").count() == 0


def record(**extra):
    return json.dumps({"EventID": 1, "ProcessGuid": "{a}", "UtcTime": "2026-01-01 00:00:00.5",
                       "Channel": tables.EXPORT_CHANNEL, **extra})


def test_json_lines_and_archive(spark, tmp_path):
    lines = [record(), record(EventID=255), record(Channel="Security"), "broken {", record(EventID="x")]
    (tmp_path / "e.json").write_text("\n".join(lines))
    assert [r.EventID for r in tables.read_event_jsonl(spark, str(tmp_path / "e.json")).collect()] == [1]
    with zipfile.ZipFile(tmp_path / "case1.zip", "w") as z:
        z.writestr("inner.json", "\n".join(lines))
    got = tables.read_event_zip(spark, str(tmp_path / "*.zip")).collect()
    assert [(r.run_id, r.EventID, r.platform) for r in got] == [("case1", 1, "windows")]


def test_flat_csv(spark, tmp_path):
    p = tables.FLAT_PREFIX
    head = f"{tables.FLAT_PROVIDER},{tables.FLAT_EVENT_ID},{tables.FLAT_HOST},{p}processGuid,{p}image"
    row = r"Microsoft-Windows-Sysmon,1,h1,{a},C:\\Windows\\x.exe"
    (tmp_path / "f.csv").write_text("\n".join([head, row, row, row.replace(",1,", ",255,"), row.replace("Microsoft", "Other")]))
    got = tables.read_event_flatcsv(spark, str(tmp_path)).collect()
    assert [(r.EventID, r.host_name, r.ProcessGuid, r.Image) for r in got] == [(1, "h1", "{a}", r"C:\Windows\x.exe")]


def test_connection_log(spark, tmp_path):
    (tmp_path / "conn.log").write_text(
        "#separator \\x09\n#set_separator\t,\n#empty_field\t(empty)\n#unset_field\t-\n#path\tconn\n"
        "#fields\tts\tuid\tid.orig_h\tid.orig_p\tservice\torig_bytes\n#types\ttime\tstring\n"
        "1.5\tC1\t10.0.0.1\t5000\t-\t12\n2.5\tC2\t10.0.0.2\t5001\t(empty)\t-\n#close\n")
    rows = tables.connections(tables.read_connection_log(spark, str(tmp_path / "conn.log")), "s").orderBy("uid").collect()
    assert [(r.ts, r.uid, r.orig_h, r.orig_p, r.service, r.orig_bytes, r.session) for r in rows] == [
        (1.5, "C1", "10.0.0.1", 5000, None, 12, "s"), (2.5, "C2", "10.0.0.2", 5001, None, None, "s")]


def test_discover_jobs(spark, tmp_path):
    (tmp_path / "m").mkdir(), (tmp_path / "l").mkdir()
    (tmp_path / "m" / "a_meta.json").write_text(json.dumps({"scenario": "miner", "raw_log": "/old/miner_1.log"}))
    (tmp_path / "m" / "b_meta.json").write_text(json.dumps({"scenario": "benign", "raw_log": "/gone/x.log", "label_spec": "session:0"}))
    (tmp_path / "m" / "c_meta.json").write_text(json.dumps({"scenario": "lost", "raw_log": "/gone/y.log"}))
    for name in ("miner_1.log", "benign_20260101_000000.log", "benign_20260102_000000.log"):
        (tmp_path / "l" / name).write_text("x")
    got = {r.scenario: r for r in tables.discover_jobs(spark, str(tmp_path / "m"), str(tmp_path / "l")).collect()}
    assert set(got) == {"miner", "benign"} and got["miner"].seed_cmd == "lab_sandbox"
    assert got["benign"].path.endswith("benign_20260102_000000.log") and got["benign"].seed_dir is None


def test_dataset_and_sinks(spark, tmp_path):
    lines = [xml(i, e, UtcTime=f"2026-01-01 00:00:0{i}", ProcessGuid=g, **f) for i, (e, g, f) in enumerate([
        (1, "{a}", dict(Image="/tmp/lab_sandbox/x", CommandLine="x")), (1, "{b}", dict(Image="/bin/sh", ParentProcessGuid="{a}")),
        (3, "{b}", dict(DestinationIp="1.2.3.4")), (1, "{c}", dict(Image="/bin/ls"))])]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "trojan_1.log").write_text("\n".join(lines))
    out = str(tmp_path / "events")
    source = dict(paths=str(tmp_path / "logs"), platform="linux", label_spec="lineage", dirs=["/tmp/lab_sandbox"])
    etl.build_dataset(spark, [source], out)
    events = tables.read_events(spark, out)
    got = {r.record_id: (r.label, r.is_seed, r.enriched, r.root_image, r.run_id) for r in events.collect()}
    assert got[2] == (1, 0, 1, "/tmp/lab_sandbox/x", "trojan_1") and got[3][:2] == (0, 0) and got[0][1] == 1
    before = events.count()
    sinks.write_events(events.limit(0), out)  # kept
    assert tables.read_events(spark, out).count() == before
    rows = etl.process_table(events)
    assert {r.ProcessGuid: (r.label, r.lineage) for r in rows.collect()}["{b}"] == (1, "linux|trojan_1|{a}")

    results = spark.createDataFrame([("all", "RF", 0.9), ("linux", "RF", 0.8)], "Platform string, Algorithm string, F1 double")
    sinks.write_results(results, str(tmp_path / "pooled"), str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "pooled")).columns == ["Algorithm", "F1"]
    for _ in range(2):
        sinks.append_results(results, str(tmp_path / "res"))
    appended = spark.read.parquet(str(tmp_path / "res"))
    assert appended.columns[:12] == sinks.RESULT_COLS and appended.count() == 4
    sinks.write_safe_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "safe"))
    assert spark.read.option("header", True).csv(str(tmp_path / "safe")).first().a == "'=1+1"
    m = {(r.kind, r.name.split("/")[-1]): r.value for r in sinks.manifest(spark, str(tmp_path / "logs"), {"events": events}).collect()}
    assert m["rows", "events"] == "4" and len(m["sha256", "trojan_1.log"]) == 64
    sinks.write_manifest(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "manifest"))
    sinks.append_predictions(results, str(tmp_path / "trace"), protocol="p1", fold=0)
    assert spark.read.parquet(str(tmp_path / "trace")).where("protocol = 'p1'").count() == 2
    sinks.write_alerts(results, str(tmp_path / "alerts"))
    assert spark.read.json(str(tmp_path / "alerts")).count() == 2


def test_schema_and_header_checks(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    assert clean.schema_differences({"a": a, "b": a, "c": a.withColumnRenamed("y", "z")}) == [("c", ["y"], ["z"])]
    assert clean.header_problems(["EventID", "EventID", "a"]) == {"duplicate": ["EventID"], "missing": ["ProcessGuid"]}
    bad = spark.createDataFrame([("linux", "r|1")], "platform string, run_id string")
    with pytest.raises(Exception, match="invalid platform"):
        clean.require_valid(bad).collect()
    assert clean.require_valid(bad.withColumn("run_id", F.lit("r1"))).count() == 1
