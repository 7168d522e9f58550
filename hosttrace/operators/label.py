"""Labelling: seeds, their descendants, differential baselines, plan and agent roots."""

from functools import reduce

from pyspark.sql import functions as F

from hosttrace.functions.rules import (AGENT_IMAGE, SCRIPT_HOSTS, plan_root, seed_match, suspect_path)
from hosttrace.functions.text import flag
from hosttrace.operators.clean import has_guid, process_key
from hosttrace.operators.graph import descendants, lineage_status
from hosttrace.schema import LEAKY_COLS, RUN_KEY


def family_edges(events, order=("record_id",), pid_fallback=True):
    """(child, parent) keys from creation records: the parent id, and the last process seen under the parent PID."""
    created = events.where((F.col("EventID") == 1) & has_guid(F.col("ProcessGuid")))
    last = created.groupBy(*RUN_KEY, "ProcessGuid").agg(
        F.max_by("ParentProcessGuid", F.when(has_guid(F.col("ParentProcessGuid")), F.struct(*order)))
        .alias("ParentProcessGuid"),
        F.max_by("ParentProcessId", F.when(F.col("ParentProcessId").isNotNull(), F.struct(*order)))
        .alias("ParentProcessId"))
    by_guid = last.select(process_key().alias("child"), process_key("ParentProcessGuid").alias("parent"))
    if not pid_fallback:
        return by_guid.where("parent IS NOT NULL")
    owners = (events.where(has_guid(F.col("ProcessGuid")) & F.col("ProcessId").isNotNull())
              .groupBy(*RUN_KEY, "ProcessId").agg(F.max_by("ProcessGuid", F.struct(*order)).alias("_owner"))
              .withColumnRenamed("ProcessId", "ParentProcessId"))
    by_pid = last.join(owners, [*RUN_KEY, "ParentProcessId"]).select(
        process_key().alias("child"), process_key("_owner").alias("parent"))
    return by_guid.unionAll(by_pid).where("parent IS NOT NULL")


def _mark(events, malicious, seeds, method):
    """Attach label and seed marks to every event of the marked processes."""
    marks = malicious.select("node", F.lit(True).alias("_bad")).join(
        seeds.select("node", F.lit(True).alias("_seed")), "node", "left")
    return events.withColumn("node", process_key()).join(marks, "node", "left").withColumns({
        "label": flag(F.col("_bad")), "label_method": F.lit(method), "is_seed": flag(F.col("_seed")),
    }).drop("node", "_bad", "_seed")


def label_by_lineage(events, images=(), commands=(), dirs=(), order=("record_id",)):
    """Label 1 for every event of a seed process or of any descendant of one."""
    seeds = events.where(seed_match(images, commands, dirs)).select(process_key().alias("node")).where(
        "node IS NOT NULL").distinct()
    return _mark(events, descendants(family_edges(events, order), seeds), seeds, "lineage")


def label_session(events, value):
    return events.withColumns({"label": F.lit(int(value)), "label_method": F.lit("session"),
                               "is_seed": F.lit(None).cast("int")})


def unseen_images(events, baseline, suspect_only=True):
    """Events whose image the benign baseline never ran, by default only images in world-writable places."""
    image = F.trim("Image")
    known = baseline.select(F.trim("Image").alias("_image")).where("_image <> ''").distinct()
    candidates = events.where(F.coalesce(image, F.lit("")) != "").withColumn("_image", image)
    if suspect_only:
        candidates = candidates.where(suspect_path(F.col("_image")))
    return candidates.join(known, "_image", "left_anti").drop("_image")


def label_by_baseline(labelled, baseline, suspect_only=True, order=("record_id",)):
    """Extend existing labels: unlabelled processes with unseen images, and what descends from any labelled one."""
    if "label_method" not in labelled.columns:
        labelled = labelled.withColumn("label_method", F.lit(None).cast("string"))
    unlabelled = F.coalesce(F.col("label"), F.lit(0)) != 1
    found = unseen_images(labelled.where(unlabelled), baseline, suspect_only).select(process_key().alias("node"))
    marked = labelled.where(~unlabelled).select(process_key().alias("node"))
    reached = descendants(family_edges(labelled, order), found.unionAll(marked))
    keyed = labelled.withColumn("node", process_key()).join(
        reached.select("node", F.lit(True).alias("_bad")), "node", "left")
    new = unlabelled & F.coalesce(F.col("_bad"), F.lit(False))
    return keyed.withColumns({"label_method": F.when(new, "baseline").otherwise(F.col("label_method")),
                              "label": F.when(new, 1).otherwise(F.col("label"))}).drop("node", "_bad")


def sample_lineage(events, pattern=r"^/tmp/[^/]+$"):
    """Keys of processes whose image is a submitted sample, plus all their descendants."""
    seeds = events.where(F.col("Image").rlike(pattern)).select(process_key().alias("node"))
    edges = events.where(has_guid(F.col("ParentProcessGuid"))).select(
        process_key().alias("child"), process_key("ParentProcessGuid").alias("parent"))
    return descendants(edges, seeds)


def label_by_plan(events, order=("record_id",)):
    """Label 1 below the entry points of the emulation plan."""
    roots = events.where(plan_root()).select(process_key().alias("node")).where("node IS NOT NULL").distinct()
    reached = descendants(family_edges(events, order, pid_fallback=False), roots)
    return _mark(events, reached, roots, "plan")


def label_by_agent(events, pattern=AGENT_IMAGE, shells=SCRIPT_HOSTS, cap=60, order=("record_id",)):
    """1 below an agent, 0 with a visible chain elsewhere; events of unknown origin are dropped."""
    agent, agent_parent = F.lower("Image").rlike(pattern), F.lower("ParentImage").rlike(pattern)
    roots = events.where(agent).select(process_key().alias("node")).unionAll(
        events.where(agent_parent).select(process_key("ParentProcessGuid").alias("node")))
    created = events.where((F.col("EventID") == 1) & has_guid(F.col("ProcessGuid")))
    first = created.groupBy(*RUN_KEY, "ProcessGuid").agg(
        F.min_by(F.struct("ParentProcessGuid", "ParentImage"), F.struct(*order)).alias("_e")).select(
        *RUN_KEY, "ProcessGuid", "_e.*")
    forest = first.select(process_key().alias("node"), process_key("ParentProcessGuid").alias("parent"),
                          "ParentImage")
    status = lineage_status(forest, roots, shells, cap=cap)
    return (events.drop("label").withColumn("node", process_key()).join(status, "node", "left")
            .withColumn("label", F.coalesce("status", F.lit(-1))).where("label >= 0").drop("node", "status"))


def perfect_predictors(events, most_values=200, exclude=("label", "label_method", "is_seed")):
    """Columns whose every non-empty value goes with a single label, if they have at most ``most_values`` values.

    Counts are exact: (column, value) rows are pre-aggregated before the shuffle, which deals them by both, so a column
    of many values spreads like any other.
    """
    columns = [c for c in events.columns if c not in exclude]
    values = events.select("label", *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        "label", columns, "column", "value").where("value <> ''")
    per_value = values.groupBy("column", "value").agg(
        (F.min(F.coalesce(F.col("label"), F.lit(-1))) == F.max(F.coalesce(F.col("label"), F.lit(-1)))).alias("pure"))
    return (per_value.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"), F.bool_and("pure").alias("pure"))
            .where((F.col("n_values") <= most_values) & F.col("pure"))
            .select("column", "n_values", F.col("column").isin(LEAKY_COLS).alias("leaky")))
