"""Event tables from CSV, JSON lines, archives and flattened exports, connection logs, and job discovery."""

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hosttrace.operators.clean import conform
from hosttrace.schema import EVENT_SCHEMA, INTERNAL_EVENT_ID, column_type
from hosttrace.sources.logs import file_stem, parse_events, read_linux_log

# What the public exports keep and how their columns are called.
EXPORT_FIELDS = [
    "EventID", "UtcTime", "ProcessGuid", "ParentProcessGuid", "Image", "CommandLine", "ParentCommandLine",
    "ParentImage", "TargetFilename", "DestinationIp", "DestinationPort", "TargetObject", "Device", "User",
    "IntegrityLevel", "CurrentDirectory", "Hashes", "EventType", "Hostname",
]
EXPORT_CHANNEL = "Microsoft-Windows-Sysmon/Operational"
ARCHIVE_FIELDS = [c for c in EXPORT_FIELDS if c not in ("IntegrityLevel", "CurrentDirectory", "Hashes", "EventType")]
FLAT_PREFIX = "_source.data.win.eventdata."
FLAT_FIELDS = {
    "processGuid": "ProcessGuid", "parentProcessGuid": "ParentProcessGuid", "utcTime": "UtcTime", "image": "Image",
    "commandLine": "CommandLine", "parentCommandLine": "ParentCommandLine", "parentImage": "ParentImage",
    "targetFilename": "TargetFilename", "destinationIp": "DestinationIp", "destinationPort": "DestinationPort",
    "targetObject": "TargetObject", "device": "Device", "user": "User", "integrityLevel": "IntegrityLevel",
    "currentDirectory": "CurrentDirectory", "hashes": "Hashes", "eventType": "EventType",
}
FLAT_PROVIDER, FLAT_EVENT_ID, FLAT_HOST = (
    "_source.data.win.system.providerName", "_source.data.win.system.eventID", "_source.agent.name")
PUBLIC_COLUMNS = [
    "EventID", "UtcTime", "ProcessGuid", "ParentProcessGuid", "Image", "CommandLine", "ParentCommandLine",
    "TargetFilename", "DestinationIp", "DestinationPort", "TargetObject", "Device", "label",
]


def _typed(df):
    """Declared types for known columns, '' to NULL."""
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if dict(df.dtypes)[name] == "string":
            c = F.when(c != "", c)
        kind = column_type(name)
        if isinstance(kind, T.IntegerType):
            c = c.cast("string").try_cast("double").cast("int")
        elif not isinstance(kind, T.StringType):
            c = c.cast("string").try_cast(kind)
        out.append(c.alias(name))
    return df.select(*out)


def numbered(events):
    """``record_id`` in reading order for tables that came without the log's own sequence number."""
    return events if "record_id" in events.columns else events.withColumn("record_id", F.monotonically_increasing_id())


def run_of_file(path, suffix="_labeled"):
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.regexp_replace(F.regexp_replace(name, r"\.(csv|csv\.gz|json|zip|log|xml)$", ""), suffix + "$", "")


def read_event_csv(spark, paths, columns=None, multiline=True):
    """Event CSV files with header, plain or gzipped, any column order; run_id is the file name unless present.

    ``multiline=False`` says that no quoted value holds a line end; then a large file is split over many tasks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames = []
    for p in paths:  # one header per path or glob; files under one glob share it
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(p)
        if "run_id" not in raw.columns:
            raw = raw.select("*", run_of_file(F.col("_metadata.file_path")).alias("run_id"))
        frames.append(_typed(raw))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return conform(out, columns) if columns else out


def _export(df, fields):
    known = [f for f in fields if f in df.columns]
    event = F.col("EventID").cast("string").try_cast("double")
    kept = df.where(event.isNotNull() & (event != INTERNAL_EVENT_ID)).select(*known)
    return numbered(conform(_typed(kept), fields))


def _json_schema(fields):
    return T.StructType([T.StructField(c, T.StringType()) for c in [*fields, "Channel", "SourceName"]])


def read_event_jsonl(spark, paths, channel=EXPORT_CHANNEL):
    """JSON-lines export; only the telemetry channel. The declared schema reads only the wanted fields."""
    raw = spark.read.schema(_json_schema(EXPORT_FIELDS)).json(paths)
    return _export(raw.where(F.col("Channel") == channel), EXPORT_FIELDS)


def _unzip(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for name in archive.namelist():
                    if name.endswith("/") or ".." in name:
                        continue
                    with archive.open(name) as lines:
                        rows = []
                        for line in lines:
                            rows.append(line.decode("utf-8", "replace"))
                            if len(rows) == 10_000:
                                yield pd.DataFrame({"path": path, "line": rows})
                                rows = []
                        if rows:
                            yield pd.DataFrame({"path": path, "line": rows})


def read_event_zip(spark, paths):
    """Archives of JSON lines, one task per archive, lines streamed out in small batches; broken lines are skipped."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    lines = files.mapInPandas(_unzip, "path string, line string")
    parsed = lines.select(run_of_file(F.col("path")).alias("run_id"),
                          F.from_json("line", _json_schema(ARCHIVE_FIELDS)).alias("e")).select("run_id", "e.*")
    source = F.coalesce("Channel", "SourceName", F.lit(""))
    kept = parsed.where(source.contains("Sysmon"))
    return _export(kept, [*ARCHIVE_FIELDS, "run_id"]).withColumn("platform", F.lit("windows"))


def read_event_flatcsv(spark, paths, provider="Microsoft-Windows-Sysmon", multiline=True):
    """Flattened-JSON CSV export: one provider, plain column names, single backslashes, no repeated rows.

    ``record_id`` is the place of a row's first copy.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(paths)

    def column(name):
        return F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")

    def single(c):
        return F.replace(c, F.lit("\\\\"), F.lit("\\"))

    kept = raw.where(column(FLAT_PROVIDER) == provider).select(
        *[single(column(FLAT_PREFIX + k)).alias(v) for k, v in FLAT_FIELDS.items()],
        column(FLAT_EVENT_ID).try_cast("int").alias("EventID"), single(column(FLAT_HOST)).alias("host_name"))
    rows = numbered(_typed(kept.where(F.coalesce("EventID", F.lit(0)) != INTERNAL_EVENT_ID)))
    values = [c for c in rows.columns if c != "record_id"]
    return rows.groupBy(*values).agg(F.min("record_id").alias("record_id"))


def read_event_folder(spark, paths):
    """A folder of line logs through the event parser; run_id is the file name."""
    return parse_events(read_linux_log(spark, paths), "linux").withColumn("run_id", F.col("session"))


def read_public_csv(spark, paths, columns=PUBLIC_COLUMNS, platform="windows", multiline=True):
    """Column subset of a labelled CSV, ready for feature building; columns it lacks are NULL."""
    rows = read_event_csv(spark, paths, [*columns, "run_id"], multiline)
    return numbered(rows).withColumn("platform", F.lit(platform))


def read_connection_log(spark, path):
    """Tab-separated connection logs with `#` header lines; unset and empty markers become NULL.

    Every file is read by its own header: the separator, markers and field order may differ between files, and columns
    are those of all layouts together. Headers stay in the cluster, one row a file; only the distinct layouts reach the
    driver. ``line_no`` keeps the order of lines.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                        F.monotonically_increasing_id().alias("line_no"))
    line = F.col("value")
    heads = text.where(line.startswith("#")).groupBy("_file").agg(*[
        F.min_by("value", F.when(line.startswith("#" + k), F.col("line_no"))).alias(k)
        for k in ("separator", "unset_field", "empty_field", "fields")])
    named = F.trim(F.split("separator", " ", 2)[1])
    heads = heads.withColumn("_sep", F.coalesce(
        F.when(named.startswith("\\x"), F.decode(F.unhex(F.substring(named, 3, 2)), "UTF-8")), named, F.lit("\t")))
    quoted = F.concat(F.lit("\\Q"), F.col("_sep"), F.lit("\\E"))

    def rest(name):
        return F.split(name, quoted, 2)[1]

    heads = heads.select("_file", "_sep", F.coalesce(rest("unset_field"), F.lit("-")).alias("_unset"),
                         F.coalesce(rest("empty_field"), F.lit("(empty)")).alias("_empty"),
                         F.split(rest("fields"), quoted, -1).alias("_fields"))
    layouts = heads.select("_fields").distinct().collect()
    names = list(dict.fromkeys(f for r in layouts for f in r["_fields"] or []))
    body = text.where(~line.startswith("#") & (line != "")).join(heads, "_file").withColumn(
        "_parts", F.split("value", quoted, -1))

    def value(name):
        at = F.nullif(F.array_position("_fields", name).cast("int"), F.lit(0))
        v = F.try_element_at("_parts", at)
        return F.when((v != "") & (v != F.col("_unset")) & (v != F.col("_empty")), v)

    return body.select(*[value(f).alias(f.replace(".", "_")) for f in names], "line_no")


def connections(conn, session):
    """Typed connection rows with plain column names."""
    names = {"id_orig_h": "orig_h", "id_orig_p": "orig_p", "id_resp_h": "resp_h", "id_resp_p": "resp_p"}
    out = conn.withColumnsRenamed(names).withColumn("session", F.lit(session))
    numbers = {"ts": "double", "orig_p": "int", "resp_p": "int", "duration": "double", "orig_bytes": "long",
               "resp_bytes": "long", "orig_pkts": "long", "resp_pkts": "long", "orig_ip_bytes": "long",
               "resp_ip_bytes": "long"}
    return out.withColumns({c: F.col(c).try_cast(t) for c, t in numbers.items() if c in out.columns})


def discover_jobs(spark, metadata, logs, raw_key="raw_log", seed_dir="/tmp/lab_sandbox", seed_cmd="lab_sandbox"):
    """Runs to build: metadata JSON paired with its raw log, with a label spec from the metadata when none is given.

    Log files are listed, not read. A log moved since capture is found again by its scenario prefix, latest name last.
    """
    meta = spark.read.schema(f"scenario string, {raw_key} string, label_spec string").option(
        "multiLine", True).json(metadata)
    files = spark.read.format("binaryFile").load(logs).select(
        "path", "length", file_stem(F.col("path")).alias("stem"))
    named = meta.where("scenario IS NOT NULL").withColumn("stem", file_stem(F.col(raw_key)))
    exact = named.join(files, "stem", "left")
    prefix = F.regexp_replace(files.stem, r"_\d{8}_\d{6}$|_\d+$", "")
    latest = files.withColumn("scenario", prefix).groupBy("scenario").agg(
        F.max_by(F.struct("path", "length", "stem"), "stem").alias("l"))
    joined = exact.join(latest, "scenario", "left").where("path IS NOT NULL OR l IS NOT NULL")
    session = F.coalesce("label_spec", F.lit("lineage")).startswith("session:")
    return joined.select(
        "scenario", F.coalesce("path", "l.path").alias("path"), F.coalesce("length", "l.length").alias("bytes"),
        F.coalesce("label_spec", F.lit("lineage")).alias("label_spec"),
        F.when(~session, F.lit(seed_dir)).alias("seed_dir"), F.when(~session, F.lit(seed_cmd)).alias("seed_cmd"))


def read_events(spark, paths):
    """Events written by ``write_events``; run_id prunes partitions."""
    return spark.read.schema(EVENT_SCHEMA).parquet(paths)
