"""Data-quality, leakage and label audits as report tables."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from hosttrace.functions.rules import SANDBOX, SANDBOX_COLS, tier_rank, with_evidence
from hosttrace.functions.text import flag, scenario
from hosttrace.operators.clean import column_fill, drop_unkeyed, process_key
from hosttrace.operators.features import ORDER, first_value
from hosttrace.operators.graph import chain_text, parent_status
from hosttrace.schema import PROCESS_KEY


def _count(name="n"):
    return F.count(F.lit(1)).alias(name)


def _rate(condition, name):
    return F.avg(F.when(condition, 1.0).otherwise(0.0)).alias(name)


# --- filling ------------------------------------------------------------------------------------------------------

def fill_report(df):
    """Filled share per column in percent and whether the column is empty."""
    share = F.coalesce(F.try_divide(F.col("filled") * 100.0, F.col("total")), F.lit(0.0))
    return column_fill(df).select("column", "filled", share.alias("pct"), (F.col("filled") == 0).alias("empty"))


def fill_gain(before, after, columns):
    """Filled counts of the inherited columns before and after enrichment."""
    b = column_fill(before.select(*columns)).select("column", F.col("filled").alias("before"), "total")
    a = column_fill(after.select(*columns)).select("column", F.col("filled").alias("after"))
    return b.join(a, "column").select("column", "before", "after", "total",
                                      (F.col("after") > F.col("before")).alias("gained"))


def fill_by_group(df, group, columns):
    """Filled share in percent per (group, column): one aggregate, then a reshape of the few result rows."""
    counts = df.groupBy(group).agg(_count("_n"), *[F.count(c).alias(c) for c in columns])
    return counts.unpivot([group, "_n"], columns, "column", "filled").select(
        group, "column", (F.col("filled") * 100.0 / F.col("_n")).alias("pct"))


def fill_gap(df, first, second, columns, group="platform", least=20.0):
    """Columns whose filled share differs by ``least`` points or more between two groups."""
    wide = fill_by_group(df, group, columns).groupBy("column").pivot(group, [first, second]).agg(F.first("pct"))
    gap = F.abs(F.coalesce(first, F.lit(0.0)) - F.coalesce(second, F.lit(0.0)))
    return wide.withColumn("gap", gap).where(F.col("gap") >= least)


def field_inventory(fields):
    """Per event id and field: how often present, how often useful, and whether never useful.

    ``fields`` has EventID, name and value, one row per logged field.
    """
    useful = F.coalesce(~F.trim("value").isin("", "-"), F.lit(False))
    return fields.groupBy("EventID", "name").agg(_count("present"), F.count_if(useful).alias("useful")).withColumn(
        "always_empty", F.col("useful") == 0)


# --- composition --------------------------------------------------------------------------------------------------

def label_crosstab(events):
    """Events per event id and label."""
    return events.groupBy("EventID").agg(
        F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("malicious"), _count())


def run_sizes(events, by=("run_id",)):
    return events.groupBy(*by).agg(_count("events"), _rate(F.col("label") == 1, "malicious_rate"))


def sensor_gaps(events, run="run_id"):
    """Event ids that some runs have and others lack, one row per (event id, run that lacks it).

    Works on the distinct (run, id) pairs: an id missing from a run shows as a run count below the total, and the
    missing runs follow from the small grid of partial ids.
    """
    pairs = events.select(run, "EventID").where("EventID IS NOT NULL").distinct()
    runs = events.select(run).distinct()
    total = runs.count()
    partial = pairs.groupBy("EventID").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") < total)
    ids = [r["EventID"] for r in partial.collect()]  # at most the sensor's vocabulary of event ids
    if not ids:
        return events.sparkSession.createDataFrame([], f"{run} string, EventID int")
    grid = runs.withColumn("EventID", F.explode(F.array(*[F.lit(i) for i in ids])))
    return grid.join(pairs, [run, "EventID"], "left_anti")


def sensor_gap_counts(events, run="run_id"):
    return sensor_gaps(events, run).groupBy("EventID").agg(_count("n_missing"))


def host_purity(events, host="computer"):
    """Label mix per host; a host that carries a single label identifies it."""
    counts = events.groupBy(host).agg(_count(), F.count_if(F.col("label") == 1).alias("malicious"))
    return counts.withColumns({"malicious_pct": F.col("malicious") * 100.0 / F.col("n"),
                               "single_label": F.col("malicious").isin(0) | (F.col("malicious") == F.col("n"))})


def empty_command_purity(events, limit=90.0):
    """How well a missing command line alone predicts the label."""
    empty = F.coalesce(F.col("CommandLine"), F.lit("")).isin("", "-")
    counts = events.agg(_count("total"), F.count_if(empty).alias("empty"),
                        F.count_if(empty & (F.col("label") == 0)).alias("benign"),
                        F.count_if(empty & (F.col("label") == 1)).alias("malicious"))
    best = F.coalesce(F.try_divide(F.greatest("benign", "malicious") * 100.0, F.col("empty")), F.lit(0.0))
    return counts.withColumn("purity_pct", best).withColumn("leaks", F.col("purity_pct") > limit)


def label_share_gap(events, first, second, group="platform", least=15.0):
    """Label share per group side by side, and whether the group gives the label away."""
    shares = events.agg(*[
        (F.avg(F.when(F.col(group) == g, F.when(F.col("label") == 1, 100.0).otherwise(0.0)))).alias(g)
        for g in (first, second)])
    return shares.withColumn("gap", F.abs(F.col(first) - F.col(second))).withColumn("leaks", F.col("gap") >= least)


def one_sided_events(events, first, second, group="platform"):
    """Event ids that occur in exactly one of two groups."""
    counts = events.groupBy("EventID").agg(
        F.count_if(F.col(group) == first).alias(first), F.count_if(F.col(group) == second).alias(second))
    return counts.where((F.col(first) == 0) != (F.col(second) == 0))


def merge_verdict(events, first, second, group="platform", platform_accuracy=None):
    """Reasons against a plain union of two groups, one row each.

    ``platform_accuracy``: how often a model tells the groups apart, if one was fitted.
    """
    share = label_share_gap(events, first, second, group).where("leaks").select(
        F.lit("label_share_gap").alias("reason"), F.col("gap").alias("value"))
    sided = one_sided_events(events, first, second, group).agg(F.count(F.lit(1)).cast("double").alias("value")).where(
        "value > 0").select(F.lit("one_sided_event_ids").alias("reason"), "value")
    out = share.unionByName(sided)
    if platform_accuracy is not None and platform_accuracy > 0.95:
        out = out.unionByName(events.sparkSession.range(1).select(
            F.lit("platform_predictable").alias("reason"), F.lit(float(platform_accuracy)).alias("value")))
    return out


def event_shares(events, by=()):
    """Share of each event id in percent, per group."""
    counts = events.groupBy(*by, "EventID").agg(_count())
    if by:
        total = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
        return counts.join(total, list(by)).select(*by, "EventID", "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct"))
    w = Window.partitionBy(F.lit(1))  # one row per event id by now
    return counts.select("EventID", "n", (F.col("n") * 100.0 / F.sum("n").over(w)).alias("pct"))


def composition_difference(a, b):
    """Per event id the two shares and their difference; the distance is the sum of |difference| (0 to 200)."""
    return a.select("EventID", F.col("pct").alias("pct_a")).join(
        b.select("EventID", F.col("pct").alias("pct_b")), "EventID", "full_outer").fillna(0.0).withColumn(
        "difference", F.col("pct_b") - F.col("pct_a"))


def composition_distance(a, b):
    return composition_difference(a, b).agg(F.sum(F.abs("difference")).alias("distance"))


def distance_to_pooled(events, host):
    """Distance of every host's composition from the pooled one."""
    pooled = event_shares(events).select("EventID", F.col("pct").alias("pooled"))
    shares = event_shares(events, [host])
    joined = shares.join(pooled, "EventID")
    # ids a host lacks count with their whole pooled share
    return joined.groupBy(host).agg(
        (F.sum(F.abs(F.col("pct") - F.col("pooled"))) + 100.0 - F.sum("pooled")).alias("distance"))


def host_pair_distances(events, host):
    """Distance between every two hosts' compositions, from the small (host, event id) share table."""
    shares = event_shares(events, [host]).select(host, "EventID", "pct")
    profile = shares.groupBy(host).agg(F.map_from_entries(F.collect_list(F.struct("EventID", "pct"))).alias("p"))
    a, b = profile.select(F.col(host).alias("a"), F.col("p").alias("pa")), profile.select(
        F.col(host).alias("b"), F.col("p").alias("pb"))
    ids = F.array_union(F.map_keys("pa"), F.map_keys("pb"))
    gap = F.aggregate(ids, F.lit(0.0), lambda acc, i: acc + F.abs(
        F.coalesce(F.try_element_at("pa", i), F.lit(0.0)) - F.coalesce(F.try_element_at("pb", i), F.lit(0.0))))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", gap.alias("distance"))


def dataset_comparison(ours, other):
    """Event mix and malicious rate per event id, side by side."""
    def side(df, name):
        counts = df.groupBy("EventID").agg(_count(), F.count_if(F.col("label") == 1).alias("m"))
        total = df.count()
        return counts.select("EventID", F.col("n").alias(name + "_n"),
                             (F.col("n") * 100.0 / F.lit(total)).alias(name + "_pct"),
                             (F.col("m") * 100.0 / F.col("n")).alias(name + "_malicious_pct"))
    return side(other, "other").join(side(ours, "ours"), "EventID", "full_outer").fillna(0)


# --- evidence and labels ------------------------------------------------------------------------------------------

def evidence_tiers(events):
    """Malicious events per evidence tier; LINEAGE are those without any evidence of their own."""
    tier = F.when(F.col("tier") == "none", "LINEAGE").otherwise(F.col("tier"))
    counted = with_evidence(events.where(F.col("label") == 1)).groupBy(tier.alias("tier")).agg(_count())
    w = Window.partitionBy(F.lit(1))  # four rows at most
    return counted.select("tier", "n", (F.col("n") * 100.0 / F.sum("n").over(w)).alias("pct"))


def evidence_samples(events, per_technique=6, order="record_id"):
    """Up to ``per_technique`` quoted pieces of evidence per (tier, technique), earliest first."""
    found = with_evidence(events.where(F.col("label") == 1)).where("tier <> 'none'")
    w = Window.partitionBy("tier", "technique").orderBy(order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_technique).select(
        "tier", "technique", "rank", "EventID", "evidence")


def audit_processes(events, key=PROCESS_KEY, order=ORDER):
    """One row per process with its strongest evidence, sandbox reference, parent status and ancestor chain."""
    sandbox = reduce(lambda a, b: a | b, [
        F.coalesce(F.col(c).rlike(SANDBOX), F.lit(False)) for c in SANDBOX_COLS if c in events.columns])
    marked = with_evidence(drop_unkeyed(events)).withColumn("_sandbox", sandbox)
    ordering = F.struct(*[F.col(c) for c in order])
    best = F.min_by(F.struct("tier", "technique", "evidence"), F.struct((-tier_rank(F.col("tier"))).alias("r"), ordering))
    grouped = marked.groupBy(*key).agg(
        best.alias("_best"), F.max("label").alias("label"), F.min("session").alias("session"), _count("n_events"),
        F.max(flag(F.col("EventID") == 1)).alias("has_create"), F.max(flag(F.col("_sandbox"))).alias("sandbox_ref"),
        *([F.max("is_seed").alias("is_seed")] if "is_seed" in events.columns else []),
        first_value(F.col("ParentProcessGuid"), order).alias("ParentProcessGuid"),
        *[first_value(F.col(c), order).alias(c) for c in
          ("Image", "CommandLine", "CurrentDirectory", "ParentImage", "ParentCommandLine")])
    p = grouped.select("*", "_best.*").drop("_best").withColumns({
        "node": process_key(), "parent": process_key("ParentProcessGuid"), "scenario": scenario(F.col("session"))})
    p = p.withColumn("attack_run", flag(~F.col("scenario").startswith("benign")))
    return parent_status(p, "node", "parent")


def with_chain(processes, length=12):
    return processes.join(chain_text(processes, length), "node", "left")


def evidence_specificity(processes):
    """Per technique, the percentage of processes showing it in benign runs and on both sides of attack runs."""
    group = F.when(F.col("attack_run") == 0, "benign_run").when(
        F.col("label") == 0, "attack_run_label0").otherwise("attack_run_label1")
    names = ["benign_run", "attack_run_label0", "attack_run_label1"]
    technique = F.when(F.col("technique") == "", "(none)").otherwise(F.col("technique"))
    cells = processes.groupBy(technique.alias("technique"), group.alias("g")).agg(_count())
    totals = {r["g"]: r["n"] for r in cells.groupBy("g").agg(F.sum("n").alias("n")).collect()}  # three rows
    return cells.groupBy("technique").agg(*[
        F.round(F.coalesce(F.sum(F.when(F.col("g") == g, F.col("n"))), F.lit(0)) * 100.0 / max(totals.get(g, 0), 1), 2)
        .alias(g) for g in names])


def with_strong_evidence(processes):
    """Direct evidence by a technique that never fires in benign runs, or a sandbox reference."""
    common = processes.where("attack_run = 0 AND tier = 'DIRECT'").select(
        "technique", F.lit(True).alias("_common")).distinct()
    joined = processes.join(common, "technique", "left")
    strong = (F.col("sandbox_ref") == 1) | ((F.col("tier") == "DIRECT") & F.col("_common").isNull())
    return joined.withColumn("strong_evidence", flag(strong)).drop("_common")


def label_audit_summary(processes):
    """Counts that describe the labels; ``processes`` comes from ``with_strong_evidence``."""
    c = F.col
    mal, attack0 = c("label") == 1, (c("attack_run") == 1) & (c("label") == 0)
    strong, direct = c("strong_evidence") == 1, c("tier") == "DIRECT"
    tests = {
        "malicious": mal, "benign": c("label") == 0,
        "malicious_with_evidence": mal & ((c("tier") != "none") | (c("sandbox_ref") == 1)),
        "malicious_with_strong_evidence": mal & strong, "possible_fn": attack0 & strong,
        "weak_evidence_label0": attack0 & direct & ~strong,
        "lineage_only_malicious": mal & (c("tier") == "none") & (c("sandbox_ref") == 0),
        "label1_in_benign_runs": mal & (c("attack_run") == 0),
        "parent_not_logged": c("parent_status") == "parent_not_logged",
    }
    return processes.agg(_count("processes"), *[F.count_if(t).alias(n) for n, t in tests.items()])


def label_audit_by_scenario(processes):
    c = F.col
    return processes.groupBy("platform", "scenario").agg(
        _count("n"), F.count_if(c("label") == 1).alias("mal"),
        F.count_if(c("parent_status") != "observed").alias("not_logged"),
        F.count_if((c("attack_run") == 1) & (c("label") == 0) & (c("strong_evidence") == 1)).alias("possible_fn"),
        F.count_if((c("label") == 1) & (c("tier") == "none") & (c("sandbox_ref") == 0)).alias("lineage_only"))


def counts_by(processes, column, values, by=("platform", "scenario", "label")):
    """One column per value: lineage completeness, evidence tiers."""
    return processes.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


# --- inventories --------------------------------------------------------------------------------------------------

def dataset_inventory(events, by):
    return events.groupBy(*by).agg(F.count_distinct("run_id").alias("runs"), _count("events"),
                                   _rate(F.col("label") == 1, "label1"))


def key_impact(events, order=ORDER):
    """Samples, positives, dropped events and keys that span runs or platforms, under both process keys."""
    guid = events.where(F.col("ProcessGuid").isNotNull())
    composite = drop_unkeyed(events)

    def stats(df, key, name):
        per_key = df.groupBy(*key).agg(F.max("label").alias("label"), F.count_distinct("run_id").alias("runs"),
                                       F.count_distinct("platform").alias("platforms"), _count("events"))
        return per_key.agg(_count("samples"), F.count_if(F.col("label") == 1).alias("malicious"),
                           F.count_if(F.col("runs") > 1).alias("keys_spanning_runs"),
                           F.count_if(F.col("platforms") > 1).alias("keys_spanning_platforms"),
                           F.sum("events").alias("_kept")).withColumn("key", F.lit(name))

    total = events.count()
    both = stats(guid, ["ProcessGuid"], "guid").unionByName(stats(composite, PROCESS_KEY, "composite"))
    return both.select("key", "samples", "malicious", (F.col("samples") - F.col("malicious")).alias("benign"),
                       (F.lit(total) - F.col("_kept")).alias("events_dropped"), "keys_spanning_runs",
                       "keys_spanning_platforms")


def dataset_summary(processes):
    """Lineage groups and classes per run; ``processes`` has run_id, session, label and lineage."""
    benign_run = F.col("session").startswith("benign")
    return processes.groupBy("platform", "run_id").agg(
        _count("processes"), F.count_if(F.col("label") == 1).alias("malicious"),
        F.count_distinct("lineage").alias("lineages"),
        F.count_if((F.col("label") == 0) & benign_run).alias("benign_in_benign_runs"),
        F.count_if((F.col("label") == 0) & ~benign_run).alias("benign_in_attack_runs"))


def label_conflicts(events, key=PROCESS_KEY):
    """Processes whose events disagree on the label."""
    return drop_unkeyed(events).groupBy(*key).agg(
        F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*key)


def flagged_types(predictions, kind="attack_type"):
    """Attack types among flagged rows: counts, shares, mean confidence."""
    hit = predictions.where("pred = 1").groupBy(kind).agg(_count(), F.avg("type_confidence").alias("confidence"))
    w = Window.partitionBy(F.lit(1))  # one row per type
    return hit.withColumn("share", F.col("n") / F.sum("n").over(w))
