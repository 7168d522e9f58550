"""Writing events, results, alerts and manifests."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hosttrace.functions.text import formula_safe

RESULT_COLS = [
    "Learning_Type", "Algorithm", "Level", "Protocol", "Features", "PCA_Components", "Accuracy", "Precision",
    "Recall", "F1", "AUC", "Flag_Rate",
]


def write_events(events, path, force=False, fmt="parquet"):
    """Events partitioned by run. Existing output stays unless ``force``.

    Rows are rebalanced by run before the write: Spark splits a large run into as many tasks as its size asks for and
    joins small ones.
    """
    out = events.hint("rebalance", "run_id").write.mode("overwrite" if force else "ignore").partitionBy("run_id")
    if fmt == "csv":
        out.option("header", True).csv(path)
    else:
        out.format(fmt).save(path)


def write_results(rows, pooled_path, by_platform_path, force=False):
    """Pooled rows and per-platform rows to two tables, kept if already there."""
    mode = "overwrite" if force else "ignore"
    rows.where(F.col("Platform") == "all").drop("Platform").write.mode(mode).parquet(pooled_path)
    rows.where(F.col("Platform") != "all").write.mode(mode).parquet(by_platform_path)


def append_results(rows, path, columns=RESULT_COLS):
    """Append with the fixed columns first, missing ones as NULL, extra ones behind."""
    kinds = {"Learning_Type": "string", "Algorithm": "string", "Level": "string", "Protocol": "string",
             "Features": "int", "PCA_Components": "int"}
    fixed = [F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in columns]
    rows.select(*fixed, *[c for c in rows.columns if c not in columns]).write.mode("append").parquet(path)


def write_alerts(alerts, path):
    """Alerts as JSON lines, appended."""
    alerts.write.mode("append").json(path)


def stream_alerts(alerts, path, checkpoint, available_now=False):
    """Streaming JSON sink; the checkpoint lets a restarted query continue without repeating alerts."""
    writer = alerts.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def write_safe_csv(df, path):
    """CSV whose text cannot run as spreadsheet formulas."""
    safe = [formula_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields]
    df.select(*safe).write.option("header", True).csv(path)


def manifest(spark, inputs, tables):
    """Provenance rows (kind, name, value): SHA-256 and size per input file, row counts per table."""
    def fact(kind, value):
        return F.struct(F.lit(kind).alias("kind"), F.col("path").alias("name"), value.alias("value"))

    files = spark.read.format("binaryFile").load(inputs).select(F.explode(F.array(
        fact("sha256", F.sha2("content", 256)), fact("bytes", F.col("length").cast("string")))).alias("m")).select("m.*")
    counts = [df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit("rows").alias("kind"), F.lit(name).alias("name"), "value") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), [files, *counts])


def run_manifest(processes):
    """Per run and split: processes, positives, lineages."""
    return processes.groupBy("platform", "run_id", "split").agg(
        F.count(F.lit(1)).alias("processes"), F.sum("label").alias("positives"),
        F.count_distinct("lineage").alias("lineages"))


def write_manifest(rows, path):
    rows.coalesce(1).write.mode("overwrite").json(path)


def append_predictions(predictions, path, **tags):
    """Prediction trace with protocol tags, partitioned by protocol."""
    tagged = predictions.withColumns({k: F.lit(v) for k, v in tags.items()})
    tagged.write.mode("append").partitionBy("protocol").parquet(path)
