"""Alert rules over flagged processes."""

from functools import partial, reduce

from pyspark.sql import functions as F

from hosttrace.functions.rules import severity, severity_rank
from hosttrace.operators.ordered import lag_of, lookup_prefix, row_numbers, running
from hosttrace.session import materialize, side_by_side


def _candidates(flags, keys, window_us, least):
    """Distinct flag times with at least ``least`` flags in (t - W, t], and whether a true one is among them."""
    times = flags.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum(F.col("label").cast("long")).alias("bad"))
    now = running(times, keys, ["at"], sums={"n_to": "n", "bad_to": "bad"})
    before = lookup_prefix(times, now.withColumn("at", F.col("at") - window_us).select(*keys, "at", "n_to", "bad_to"),
                           keys, "at", sums={"n_out": "n", "bad_out": "bad"})
    return before.where(F.col("n_to") - F.col("n_out") >= least).select(
        *keys, (F.col("at") + window_us).alias("at"), (F.col("bad_to") - F.col("bad_out") > 0).alias("true_alert"))


def window_alerts(flags, window_s, least, keys=("platform", "run_id")):
    """Alerts of the rule "at least N flags within W seconds, then quiet for W seconds", one row per alert.

    ``flags`` has the keys, ``at`` (microseconds) and ``label``. The quiet period makes alerts depend on the previous
    one, but the successor of a candidate does not: it is the first candidate W or more later. Following successors
    from every candidate that has no other candidate in the W seconds before it, with jumps that double each round,
    gives the alerts in log2(longest chain) joins, on hosts with any number of flags.
    """
    keys, w = list(keys), int(window_s * 1_000_000)
    found = materialize(_candidates(flags, keys, w, least), "candidates")
    # Successor: largest -t not above -(t + W).
    mirrored = found.select(*keys, (-F.col("at")).alias("at")).withColumn("hit", F.col("at"))
    asked = found.select(*keys, F.col("at").alias("self"), (-F.col("at") - w).alias("at"))
    jump = lookup_prefix(mirrored, asked, keys, "at", maxes={"next": "hit"}).where("next IS NOT NULL").select(
        *keys, F.col("self").alias("at"), (-F.col("next")).alias("next"))
    jump = materialize(jump, "jump")
    lagged = lag_of(found, keys, ["at"], "at", "prev")
    starts = lagged.where(F.col("prev").isNull() | (F.col("at") - F.col("prev") >= w)).select(*keys, "at")
    reached = materialize(starts, "alerts")
    size = reached.count()
    while True:  # ends once a round of doubled jumps reaches nothing new
        step = reached.join(jump, [*keys, "at"]).select(*keys, F.col("next").alias("at"))
        reached = materialize(reached.unionByName(step).distinct(), "alerts")
        grown = reached.count()
        if grown == size:
            break
        size = grown
        onward = jump.select(*keys, F.col("at").alias("next"), F.col("next").alias("_far"))
        jump = materialize(jump.join(onward, [*keys, "next"]).select(*keys, "at", F.col("_far").alias("next")), "jump")
    return found.join(reached, [*keys, "at"], "left_semi")


def host_alert_summary(processes, window_s, least, keys=("platform", "run_id")):
    """One row per run: alerts, true and false alerts, detection and time to detect.

    ``processes`` has the keys, ``start``, ``det`` (NULL if never flagged) and ``label``; times are timestamps.
    """
    keys = list(keys)
    flags = processes.where("det IS NOT NULL").select(*keys, F.unix_micros("det").alias("at"), "label")
    alerts = window_alerts(flags, window_s, least, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if("true_alert").alias("true_alerts"),
        F.min(F.when(F.col("true_alert"), F.col("at"))).alias("_first"))
    runs = processes.groupBy(*keys).agg(
        F.count_if(F.col("label") == 1).alias("_attacks"),
        F.min(F.when(F.col("label") == 1, F.unix_micros("start"))).alias("_attack_start"))
    attack = F.col("_attacks") > 0
    return runs.join(alerts, keys, "left").fillna(0, ["alerts", "true_alerts"]).select(
        *keys, F.when(attack, 1).otherwise(0).alias("attack_run"), "alerts", "true_alerts",
        (F.col("alerts") - F.col("true_alerts")).alias("false_alarms"),
        F.when(attack, (F.col("true_alerts") > 0).cast("int")).alias("detected"),
        F.when(attack, (F.col("_first") - F.col("_attack_start")) / 1e6).alias("ttd_s"))


def alert_severity(flags, keys, technique="technique"):
    """Severity of an alert over flagged rows: high for three or more distinct techniques, else the highest of its flags.

    Sub-techniques count by their own number; rows without a technique count for the level alone.
    """
    level = severity_rank(severity(F.col(technique)))
    number = F.when(F.coalesce(technique, F.lit("")) != "", F.split(technique, " ")[0])
    out = flags.groupBy(*keys).agg(F.count_distinct(number).alias("_techniques"), F.max(level).alias("_rank"),
                                   F.count(F.lit(1)).alias("n_flagged"))
    high = (F.col("_techniques") >= 3) | (F.col("_rank") == 2)
    return out.select(*keys, F.when(high, "high").when(F.col("_rank") == 1, "medium").otherwise("low").alias("severity"),
                      "n_flagged")


def first_detection(scores, ages, threshold, keys=("platform", "run_id", "ProcessGuid"), strict=False):
    """First age at which a process is flagged -> wall-clock detection time; the last age means its last event.

    ``scores`` has the keys, age_ix, score, start and end.
    """
    whole = len(ages) - 1
    flagged = F.col("score") > threshold if strict else F.col("score") >= threshold
    first = scores.groupBy(*keys).agg(
        F.min(F.when(flagged, F.col("age_ix"))).alias("first_age"), F.min("start").alias("start"),
        F.max("end").alias("end"), F.max("label").alias("label"))
    after = F.array(*[F.lit(int(a * 1_000_000)) for a in ages[:-1]])
    det = F.when(F.col("first_age") == whole, F.col("end")).otherwise(
        F.timestamp_micros(F.unix_micros("start") + F.try_element_at(after, F.col("first_age") + 1)))
    return first.withColumn("det", F.when(F.col("first_age").isNotNull(), det))


def incidents(detections, k=1, group=("platform", "run_id", "lineage")):
    """Attack lineage trees: detected once k processes are flagged; time to the k-th flag."""
    group = list(group)
    attacks = detections.where(F.col("label") == 1)
    hits = attacks.where("det IS NOT NULL").withColumn("_d", F.unix_micros("det"))
    kth = row_numbers(hits, group, ["_d", "ProcessGuid"]).where(F.col("rn") == k).select(*group, "_d")
    trees = attacks.groupBy(*group).agg(F.count(F.lit(1)).alias("n_proc"), F.min("start").alias("_s"))
    return trees.join(kth, group, "left").select(
        *group, "n_proc", F.when(F.col("_d").isNotNull(), 1).otherwise(0).alias("detected"),
        ((F.col("_d") - F.unix_micros("_s")) / 1e6).alias("ttd_s"))


def false_alarms(detections, hours, k=1, group=("platform", "run_id", "lineage")):
    """Benign lineage trees with k or more flags, per run and per hour."""
    group, run = list(group), list(group)[:-1]
    trees = detections.groupBy(*group).agg(F.max("label").alias("mal"), F.count("det").alias("hits"))
    per_run = trees.where("mal = 0").groupBy(*run).agg(
        F.count(F.lit(1)).alias("benign_trees"), F.count_if(F.col("hits") >= k).alias("false_alarms"))
    return per_run.join(hours, run, "left").withColumn(
        "fa_per_hour", F.try_divide(F.col("false_alarms").cast("double"), F.col("hours")))


def run_hours(events, keys=("platform", "run_id")):
    return events.groupBy(*keys).agg(
        ((F.unix_micros(F.max("UtcTime")) - F.unix_micros(F.min("UtcTime"))) / 3.6e9).alias("hours"))


def alert_grid(processes, windows=(60, 300), least=(1, 2, 3)):
    """Host alert summaries over the rule grid; its points are independent, so their rounds run side by side."""
    points = [(w, n) for w in windows for n in least]
    rows = side_by_side(processes.sparkSession, [partial(host_alert_summary, processes, w, n) for w, n in points])
    return reduce(lambda a, b: a.unionByName(b), [r.withColumns({"W": F.lit(w), "N": F.lit(n)}) for r, (w, n) in zip(rows, points)])
