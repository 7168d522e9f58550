"""Row- and column-level cleaning, keys, schema checks and validation."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hosttrace.functions.text import normal_guid
from hosttrace.schema import FEATURE_EVENT_IDS, NULL_GUID, TRACE_COLS, WINDOWS_ONLY_EVENT_IDS

# Optional input columns and the features each of them feeds (fixed values).
OPTIONAL_COLUMNS = {
    "UtcTime": ["dur_s", "rate"], "ParentProcessGuid": [], "CommandLine": ["cmd_len"],
    "ParentCommandLine": ["pcmd_len"], "TargetFilename": ["n_files"], "DestinationIp": ["n_dst_ip"],
    "DestinationPort": ["n_dst_port"], "TargetObject": ["n_regobj"], "Device": ["n_device"],
}


def _string_columns(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def dash_to_null(df):
    return df.replace("-", None, subset=_string_columns(df))


def column_fill(df):
    """One pass: non-NULL count per column, as rows (column, filled, total)."""
    counts = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count(c).alias(c) for c in df.columns])
    return counts.unpivot("_total", df.columns, "column", "filled").select(
        "column", "filled", F.col("_total").alias("total"))


def drop_empty_columns(df):
    """Drop columns that are NULL in every row. One aggregate row reaches the driver."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select([c for c in df.columns if counts[c] > 0])


def leak_free(df, *lists):
    """``df`` without the columns of the given lists (see ``schema``): what a model may be fitted on."""
    return df.drop(*{c for names in lists for c in names})


def drop_repeats(df, order=("record_id",), trace=TRACE_COLS):
    """Keep the first row of each group that is equal on all columns but the trace columns.

    Aggregates map-side before it shuffles, so a row copied many times costs one row per task.
    """
    trace = [c for c in trace if c in df.columns]
    subset = [c for c in df.columns if c not in trace]
    if not trace:
        return df.dropDuplicates()
    first = df.groupBy(*subset).agg(F.min(F.struct(*order, *[c for c in trace if c not in order])).alias("_t"))
    return first.select(*[F.col("_t." + c).alias(c) if c in trace else F.col(c) for c in df.columns])


def has_guid(c):
    return c.isNotNull() & (c != "") & (c != NULL_GUID)


def drop_unkeyed(events):
    """Only events that carry a real process id."""
    return events.where(has_guid(F.col("ProcessGuid")))


def unkeyed_count(events):
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(has_guid(F.col("ProcessGuid"))).alias("kept"),
        F.count_if(~F.coalesce(has_guid(F.col("ProcessGuid")), F.lit(False))).alias("dropped"))


def process_key(guid="ProcessGuid"):
    """Composite key text; NULL when the id is missing or all-zero."""
    return F.when(has_guid(F.col(guid)), F.concat_ws("|", "platform", "run_id", guid))


def with_keys(events):
    return events.withColumn("pkey", process_key()).withColumn("parent_pkey", process_key("ParentProcessGuid"))


def runs_matching(df, include=None, exclude=(), column="run_id"):
    """Keep runs whose name contains any of ``include`` (all when None) and none of ``exclude``."""
    keep = F.lit(True)
    if include is not None:
        keep = reduce(lambda a, b: a | b, [F.col(column).contains(s) for s in include], F.lit(False))
    for s in exclude:
        keep = keep & ~F.col(column).contains(s)
    return df.where(keep)


def schema_differences(frames):
    """{name: DataFrame} -> [(name, missing, extra)] against the first frame's columns, order included."""
    items = list(frames.items())
    header = items[0][1].columns
    return [(name, sorted(set(header) - set(df.columns)), sorted(set(df.columns) - set(header)))
            for name, df in items[1:] if df.columns != header]


def conform(df, columns):
    """Exactly ``columns``, the missing ones as NULL."""
    from hosttrace.schema import column_type
    return df.select([F.col(c) if c in df.columns else F.lit(None).cast(column_type(c)).alias(c) for c in columns])


def normalise_guids(df, columns=("ProcessGuid", "ParentProcessGuid")):
    return df.withColumns({c: normal_guid(F.col(c)) for c in columns if c in df.columns})


def detect_platform(df, share=0.05):
    """Evidence counts per operating system; ambiguous when the weaker side exceeds ``share`` of the stronger."""
    paths = [c for c in ("Image", "TargetFilename", "CurrentDirectory") if c in df.columns]
    zero = F.lit(0).cast("long")
    windows = sum([F.count_if(F.col(c).rlike(r"^[A-Za-z]:\\")) for c in paths], zero)
    linux = sum([F.count_if(F.col(c).startswith("/")) for c in paths], zero)
    if "User" in df.columns:
        windows = windows + F.count_if(F.col("User").contains("\\"))
    windows = windows + F.count_if(F.col("EventID").isin(WINDOWS_ONLY_EVENT_IDS))
    counts = df.agg(windows.alias("windows_evidence"), linux.alias("linux_evidence"))
    win, lin = F.col("windows_evidence"), F.col("linux_evidence")
    return counts.select(win, lin, F.when(win >= lin, "windows").otherwise("linux").alias("platform"),
                         (F.least(win, lin) > share * F.greatest(win, lin)).alias("ambiguous"))


def input_violations(df, platforms=("linux", "windows"), event_ids=FEATURE_EVENT_IDS):
    """Rule violations of an event table as rows (rule, violations), counted in one pass."""
    col = F.col
    rules = {
        "platform_unknown": ~F.coalesce(F.lower(F.trim("platform")).isin(list(platforms)), F.lit(False)),
        "run_id_empty": F.coalesce(F.trim("run_id"), F.lit("")) == "",
        "run_id_has_separator": col("run_id").contains("|"),
        "event_id_not_integer": col("EventID").cast("string").try_cast("int").isNull(),
        "event_id_unknown": ~col("EventID").cast("string").try_cast("int").isin(event_ids),
    }
    if "UtcTime" in df.columns:
        rules["time_unreadable"] = col("UtcTime").cast("string").try_cast("timestamp").isNull()
    if "label" in df.columns:
        rules["label_outside_0_1"] = col("label").isNotNull() & ~F.coalesce(
            col("label").cast("string").try_cast("double").isin(0.0, 1.0), F.lit(False))
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def header_problems(columns, required=("EventID", "ProcessGuid")):
    """Duplicate and missing header names, before any row is read."""
    repeated = sorted({c for c in columns if columns.count(c) > 1})
    return {"duplicate": repeated, "missing": sorted(set(required) - set(columns))}


def require_valid(df):
    """Raise inside the job on the first row that breaks a hard rule."""
    ok = F.lower(F.trim("platform")).isin("linux", "windows") & (F.trim("run_id") != "") & ~F.contains(
        F.col("run_id"), F.lit("|"))
    return df.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("invalid platform or run_id")).isNull())


def dead_features(df, importance=None):
    """Features that turn constant because their source column is absent or empty, with their importance if given."""
    present = [c for c in OPTIONAL_COLUMNS if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first() if present else {}
    lost = [c for c in OPTIONAL_COLUMNS if c not in present or counts[c] == 0]
    dead = [(c, f) for c in lost for f in OPTIONAL_COLUMNS[c]]
    out = df.sparkSession.createDataFrame(dead, "source string, feature string")
    return out if importance is None else out.join(importance, "feature", "left").fillna(0.0, ["importance"])


def truth_known(events, key):
    """A process has usable truth only if every one of its events is labelled 0 or 1."""
    return events.groupBy(*key).agg(
        F.bool_and(F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("truth_known"),
        F.max("label").alias("label"))


REPLAY = ["UtcTime", "record_id"]


def replay_order(events):
    return events.orderBy(*REPLAY)


def union_runs(frames, columns=None):
    """UNION ALL by name. Without ``columns`` the frames must have the same ones; with it each is conformed to them."""
    if columns is None:
        different = schema_differences({str(i): f for i, f in enumerate(frames)})
        if different:
            raise ValueError(f"inputs have other columns than the first: {different}")
        columns = frames[0].columns
    return reduce(lambda a, b: a.unionByName(b), [conform(f, columns) for f in frames])


def substitute_runs(base, replacement, key=("platform", "run_id")):
    """Replace whole runs by corrected rows, returning the new table and the runs whose row count changed."""
    swapped = replacement.select(*key).distinct()
    kept = base.join(swapped, list(key), "left_anti")
    was = base.join(swapped, list(key), "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("rows_before"))
    now = replacement.groupBy(*key).agg(F.count(F.lit(1)).alias("rows_after"))
    changed = was.join(now, list(key), "full_outer").where(
        ~F.col("rows_before").eqNullSafe(F.col("rows_after")))
    return kept.unionByName(conform(replacement, base.columns)), changed
