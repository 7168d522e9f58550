"""Raw logs to labelled, merged events, and on to process tables."""

from pyspark.sql import functions as F

from hosttrace.operators import clean, enrich, features, graph, label
from hosttrace.session import materialize
from hosttrace.sources import logs, sinks


def parsed_events(spark, paths, platform):
    """Events of one platform; the run is the log file."""
    read = logs.read_windows_log if platform == "windows" else logs.read_linux_log
    return logs.parse_events(read(spark, paths), platform).withColumn("run_id", F.col("session"))


def labelled_events(events, label_spec, images=(), commands=(), dirs=(), baseline=None):
    """Enriched events with lineage, labelled by session or by descent from seeds, optionally against a baseline."""
    filled = materialize(enrich.add_lineage(enrich.enrich(events)), "enriched")
    if label_spec.startswith("session:"):
        out = label.label_session(filled, label_spec.split(":", 1)[1])
    else:
        out = label.label_by_lineage(filled, images, commands, dirs)
    return out if baseline is None else label.label_by_baseline(out, baseline)


def build_dataset(spark, sources, out, force=False):
    """One partitioned table from (paths, platform, label_spec, seeds) sources; parses, enriches, labels, merges."""
    parts = [labelled_events(materialize(parsed_events(spark, s["paths"], s["platform"]), "parsed"), s["label_spec"],
                             s.get("images", ()), s.get("commands", ()), s.get("dirs", ())) for s in sources]
    sinks.write_events(clean.union_runs(parts), out, force)
    return out


def process_table(events, behaviour=False):
    """Feature rows with label, session, scenario, harness mark and lineage root, one per process."""
    meta = features.process_meta(events)
    keyed = meta.withColumns({"node": clean.process_key(), "parent": clean.process_key("ParentProcessGuid")})
    lineage = graph.topmost(keyed).select("node", F.col("root").alias("lineage"))
    described = keyed.join(lineage, "node").select("platform", "run_id", "ProcessGuid", "lineage")
    if behaviour:
        rows = features.behaviour_features(events, whole_only=True).where(F.col("age_ix") == features.WHOLE)
    else:
        rows = features.process_features(events).join(
            meta.select("platform", "run_id", "ProcessGuid", "session", "scenario", "harness", "start"),
            ["platform", "run_id", "ProcessGuid"])
    return rows.join(described, ["platform", "run_id", "ProcessGuid"])
