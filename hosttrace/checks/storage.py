"""Readers and sinks: rows spelled from the given tables, written to the scratch folder, read back."""

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from hosttrace.checks.registry import EV, check, r6, rounded, with_ev
from hosttrace.checks.scalars import event_lines
from hosttrace.checks.telemetry import FLOWS_DUCK, flows, telemetry
from hosttrace.operators import features
from hosttrace.session import scratch_dir
from hosttrace.sources import logs, sinks, tables

_LINE_COLUMNS = ["record_id", "EventID", "event_name", "ProcessGuid", "ProcessId", "computer", "CommandLine", "parent_known"]
_LINES = """
SELECT event_id AS record_id, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 11 ELSE 77
       END AS INT) AS "EventID", CASE event_type WHEN 'view' THEN 'ProcessCreate' WHEN 'click' THEN 'NetworkConnect'
       WHEN 'purchase' THEN 'FileCreate' ELSE 'Unknown_77' END AS event_name, '{' || user_id || '}' AS "ProcessGuid",
       CAST(user_id AS INT) AS "ProcessId", 'host' || (user_id % 3) AS computer, props AS "CommandLine",
       CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS parent_known
FROM events WHERE event_type <> 'error'"""


def folder(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def with_head(lines, head):
    """Lines as text partitions that each begin with the given header lines, so that each file has them."""
    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array(head)], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, ["value"])
    return lines.mapInArrow(run, "value string")


@check("s1_linux_log", _LINES)
def s1(spark, sf):
    path = folder(spark, "linux-log")
    event_lines(spark, sf).select("value").write.text(path)
    return logs.parse_events(logs.read_linux_log(spark, path), "linux").select(*_LINE_COLUMNS)


@check("s2_windows_log", _LINES)
def s2(spark, sf):
    """Records over several lines, as exports of that platform write them."""
    path = folder(spark, "windows-log")
    xml = F.regexp_extract("value", r"(<Event>.*</Event>)", 1)
    event_lines(spark, sf).select(F.replace(xml, F.lit("<EventData>"), F.lit("\n<EventData>\r\n")).alias("value")).write.text(path)
    return logs.parse_events(logs.read_windows_log(spark, path), "windows").select(*_LINE_COLUMNS)


@check("s10_event_folder", _LINES)
def s10(spark, sf):
    path = folder(spark, "event-folder")
    event_lines(spark, sf).select("value").write.text(path)
    return tables.read_event_folder(spark, path).select(*_LINE_COLUMNS)


@check("s5_connection_log", f"""
WITH fl AS ({FLOWS_DUCK})
SELECT uid, CAST(orig_p AS INT) AS orig_p, orig_bytes, service, dns_query, session AS scenario FROM fl""")
def s5(spark, sf):
    """Two layouts in one folder tree: other separator, markers, column order, and a column that one of them lacks."""
    base, path = flows(spark, sf), folder(spark, "connections")
    layouts = [("\t", "-", "(empty)", ["uid", "orig_p", "orig_bytes", "service", "dns_query", "session"], "orig_p % 2 = 0"),
               ("|", "none", "(void)", ["dns_query", "session", "orig_bytes", "uid", "orig_p"], "orig_p % 2 = 1 AND service IS NULL"),
               ("|", "none", "(void)", ["service", "session", "dns_query", "orig_bytes", "uid", "orig_p"], "orig_p % 2 = 1 AND service IS NOT NULL")]
    names = {"orig_p": "id.orig_p", "session": "scenario"}
    for k, (sep, unset, empty, columns, where) in enumerate(layouts):
        head = [f"#separator \\x{ord(sep):02x}", f"#set_separator{sep},", f"#empty_field{sep}{empty}", f"#unset_field{sep}{unset}",
                "#fields" + sep + sep.join(names.get(c, c) for c in columns)]
        line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(unset)) for c in columns])
        with_head(base.where(where).select(line.alias("value")), head).write.text(f"{path}/part={k}")
    read = tables.read_connection_log(spark, [f"{path}/part={k}" for k in range(len(layouts))])
    return tables.connections(read, "s").select("uid", "orig_p", "orig_bytes", "service", "dns_query", "scenario")


_CSV = ["record_id", "EventID", "ProcessGuid", "Image", "CommandLine", "DestinationPort", "label", "run_id"]
_CSV_SQL = with_ev('SELECT record_id, EventID, ProcessGuid, Image, CommandLine, CAST(DestinationPort AS INT) AS DestinationPort, label, run_id FROM ev')


@check("s6_event_csv", _CSV_SQL)
def s6(spark, sf):
    """Two sets of files with other column orders, one of them compressed."""
    e, path = telemetry(spark, sf), folder(spark, "event-csv")
    write = lambda df: df.write.option("header", True).option("escape", '"')
    write(e.where("label = 0").select(*_CSV)).csv(f"{path}/a")
    write(e.where("label = 1").select(*reversed(_CSV))).option("compression", "gzip").csv(f"{path}/b")
    return tables.read_event_csv(spark, [f"{path}/a", f"{path}/b"]).select(*_CSV)


@check("s7_event_jsonl", with_ev("""
SELECT EventID, ProcessGuid, Image, CommandLine, CAST(DestinationPort AS INT) AS DestinationPort FROM ev WHERE label = 1 AND EventID <> 13"""))
def s7(spark, sf):
    path = folder(spark, "event-jsonl")
    event = F.when(F.col("EventID") == 13, "255").otherwise(F.col("EventID").cast("string"))
    telemetry(spark, sf).select(event.alias("EventID"), "ProcessGuid", "Image", "CommandLine", "DestinationPort", F.lit("x").alias("more"),
                                F.when(F.col("label") == 1, tables.EXPORT_CHANNEL).otherwise("Security").alias("Channel")).write.json(path)
    return tables.read_event_jsonl(spark, path).select("EventID", "ProcessGuid", "Image", "CommandLine", "DestinationPort")


@check("s8_event_zip", with_ev("""
SELECT EventID, ProcessGuid, Image, CommandLine, platform FROM (SELECT * REPLACE ('windows' AS platform) FROM ev) WHERE label = 1"""))
def s8(spark, sf):
    """One archive per partition, each with two members of JSON lines and a broken line."""
    path = folder(spark, "archives")
    row = F.struct("EventID", "ProcessGuid", "Image", "CommandLine",
                   F.when(F.col("label") == 1, tables.EXPORT_CHANNEL).otherwise("Security").alias("Channel"))
    lines = telemetry(spark, sf).repartition(4, "record_id").select(F.to_json(row).alias("line"))

    def pack(batches):
        rows = [r for b in batches for r in b.column(0).to_pylist()]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k in (0, 1):
                z.writestr(f"part{k}.json", "\n".join([*rows[k::2], "{broken"]))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["data"])

    lines.mapInArrow(pack, "data binary").select(F.col("data").cast("string")).write.text(path)
    return tables.read_event_zip(spark, path).select("EventID", "ProcessGuid", "Image", "CommandLine", "platform")


@check("s9_event_flatcsv", with_ev("""
SELECT DISTINCT EventID, computer AS host_name, ProcessGuid, Image, CommandLine FROM ev WHERE platform = 'windows'"""))
def s9(spark, sf):
    """Every row twice, backslashes doubled, rows of another provider between them."""
    e, path, p = telemetry(spark, sf), folder(spark, "flat-csv"), tables.FLAT_PREFIX
    doubled = lambda c: F.replace(c, F.lit("\\"), F.lit("\\\\"))
    rows = e.unionByName(e).select(
        F.when(F.col("platform") == "windows", "Microsoft-Windows-Sysmon").otherwise("Other").alias(tables.FLAT_PROVIDER),
        F.col("EventID").alias(tables.FLAT_EVENT_ID), F.col("computer").alias(tables.FLAT_HOST), F.col("ProcessGuid").alias(p + "processGuid"),
        doubled("Image").alias(p + "image"), doubled("CommandLine").alias(p + "commandLine"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_event_flatcsv(spark, path).select("EventID", "host_name", "ProcessGuid", "Image", "CommandLine")


_PUBLIC = ["n_events", "ev_1", "ev_3", "ev_11", "n_files", "n_dst_ip", "n_dst_port", "dur_s", "label"]


@check("s11_public_features", with_ev(f"""
SELECT run_id, ProcessGuid, CAST(count(*) AS DOUBLE) AS n_events, {', '.join(f'CAST(count(*) FILTER (WHERE EventID = {i}) AS DOUBLE) AS ev_{i}' for i in (1, 3, 11))},
       {', '.join(f'CAST(count(DISTINCT {c}) AS DOUBLE) AS {n}' for n, c in features.DISTINCT.items() if n in _PUBLIC)},
       {r6('(epoch_us(max(UtcTime)) - epoch_us(min(UtcTime))) / 1e6', 'dur_s')}, max(label) AS label FROM ev GROUP BY 1, 2"""))
def s11(spark, sf):
    """A reduced labelled table without sequence numbers, platform or most columns, into process features."""
    path = folder(spark, "public-csv")
    kept = ["EventID", "UtcTime", "ProcessGuid", "TargetFilename", "DestinationIp", "DestinationPort", "label", "run_id"]
    (telemetry(spark, sf).select(*kept).withColumn("UtcTime", F.date_format("UtcTime", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
     .write.option("header", True).option("escape", '"').csv(path))
    rows = features.process_features(tables.read_public_csv(spark, path))
    return rounded(rows.select("run_id", "ProcessGuid", *_PUBLIC))


@check("k1_write_events", with_ev("SELECT record_id, EventID, ProcessGuid, CommandLine, label, run_id FROM ev"))
def k1(spark, sf):
    path = folder(spark, "events")
    sinks.write_events(telemetry(spark, sf), path)
    return tables.read_events(spark, path).select("record_id", "EventID", "ProcessGuid", "CommandLine", "label", "run_id")


@check("k2_keep_or_force", with_ev("""
SELECT 'first' AS step, count(*) AS n FROM ev UNION ALL SELECT 'kept', count(*) FROM ev
UNION ALL SELECT 'forced', count(*) FILTER (WHERE label = 1) FROM ev"""))
def k2(spark, sf):
    """An output stays as it is unless a rewrite is forced."""
    e, paths = telemetry(spark, sf), [folder(spark, "events") for _ in range(3)]
    for path, steps in zip(paths, (0, 1, 2)):
        sinks.write_events(e, path)
        if steps:
            sinks.write_events(e.where("label = 1"), path, force=steps == 2)
    counts = [tables.read_events(spark, p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("step"), "n")
              for p, s in zip(paths, ("first", "kept", "forced"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _results(spark, sf):
    e = telemetry(spark, sf)
    per = lambda df, name: df.select(name.alias("Platform"), F.col("session").alias("Algorithm"), "label")
    both = per(e, F.lit("all")).unionByName(per(e, F.col("platform")))
    return both.groupBy("Platform", "Algorithm").agg(F.avg("label").alias("F1"))


_RESULTS_SQL = """(SELECT "Platform", "Algorithm", round(avg(label), 6) AS "F1" FROM (
    SELECT 'all' AS "Platform", session AS "Algorithm", label FROM ev UNION ALL SELECT platform, session, label FROM ev) GROUP BY 1, 2)"""


@check("k3_result_tables", with_ev(f"""
SELECT 'pooled' AS place, "Algorithm", "F1" FROM {_RESULTS_SQL} WHERE "Platform" = 'all'
UNION ALL SELECT "Platform", "Algorithm", "F1" FROM {_RESULTS_SQL} WHERE "Platform" <> 'all'"""))
def k3(spark, sf):
    pooled, by = folder(spark, "pooled"), folder(spark, "by-platform")
    sinks.write_results(_results(spark, sf), pooled, by)
    a = spark.read.parquet(pooled).select(F.lit("pooled").alias("place"), "Algorithm", "F1")
    return rounded(a.unionByName(spark.read.parquet(by).select(F.col("Platform").alias("place"), "Algorithm", "F1")))


@check("k4_append_results", with_ev(f"""
SELECT "Algorithm", "F1", CAST(NULL AS DOUBLE) AS "AUC", "Platform" FROM {_RESULTS_SQL}
UNION ALL SELECT "Algorithm", "F1", NULL, "Platform" FROM {_RESULTS_SQL}"""))
def k4(spark, sf):
    path = folder(spark, "results")
    for _ in range(2):
        sinks.append_results(_results(spark, sf), path)
    return rounded(spark.read.parquet(path).select("Algorithm", "F1", "AUC", "Platform"))


@check("k5_alert_lines", with_ev(f'SELECT "Platform", "Algorithm", "F1" FROM {_RESULTS_SQL}'))
def k5(spark, sf):
    path = folder(spark, "alerts")
    sinks.write_alerts(rounded(_results(spark, sf)), path)
    return spark.read.schema("Platform string, Algorithm string, F1 double").json(path)


@check("k7_row_manifest", f"""
WITH {EV} SELECT 'rows' AS kind, 'events' AS name, CAST(count(*) AS VARCHAR) AS value FROM ev
UNION ALL SELECT 'rows', 'flows', CAST(count(*) AS VARCHAR) FROM ({FLOWS_DUCK})
UNION ALL SELECT 'inputs', 'sha256', '1' UNION ALL SELECT 'inputs', 'bytes', '1'""")
def k7(spark, sf):
    """Row counts as they are; of the input file's facts, that there is one of each."""
    rows = sinks.manifest(spark, f"{sf}/region.parquet", {"events": telemetry(spark, sf), "flows": flows(spark, sf)})
    inputs = rows.where("kind <> 'rows'").groupBy("kind").agg(F.count(F.lit(1)).cast("string").alias("value"))
    return rows.where("kind = 'rows'").unionByName(inputs.select(F.lit("inputs").alias("kind"), F.col("kind").alias("name"), "value"))


@check("k8_prediction_trace", with_ev("""
SELECT t.protocol, CAST(t.fold AS INT) AS fold, record_id, label FROM ev, (VALUES ('p1', 0), ('p1', 1), ('p2', 0)) AS t(protocol, fold)"""))
def k8(spark, sf):
    path = folder(spark, "trace")
    for protocol, fold in (("p1", 0), ("p1", 1), ("p2", 0)):
        sinks.append_predictions(telemetry(spark, sf).select("record_id", "label"), path, protocol=protocol, fold=fold)
    return spark.read.parquet(path).select("protocol", "fold", "record_id", "label")
