"""Confusion metrics, ROC, thresholds and summaries over prediction tables."""

from pyspark.sql import functions as F

from hosttrace.functions.numeric import ratio, wilson
from hosttrace.operators.ordered import lookup_prefix, quantiles, running
from hosttrace.session import materialize

TARGET_FPR = 0.05
METRICS = ["Accuracy", "Precision", "Recall", "F1", "FPR", "AUC"]


def _counts(label, pred):
    return {"tp": (label == 1) & (pred == 1), "fp": (label == 0) & (pred == 1),
            "fn": (label == 1) & (pred == 0), "tn": (label == 0) & (pred == 0)}


def _from_counts(df, keep):
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return df.select(
        *keep, "tp", "fp", "fn", "tn", ratio(tp + tn, n).alias("Accuracy"), ratio(tp, tp + fp).alias("Precision"),
        ratio(tp, tp + fn).alias("Recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("F1"),
        F.try_divide(fp.cast("double"), (fp + tn).cast("double")).alias("FPR"),
        ratio(tp + fp, n).alias("Flag_Rate"))


def confusion_metrics(df, by=(), label="label", pred="pred"):
    """Metrics per group; zero denominators give 0, except FPR, which is NULL without negatives."""
    tests = _counts(F.col(label), F.col(pred))
    grouped = df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    return _from_counts(grouped, list(by))


def pooled_and_by(df, group, by=(), label="label", pred="pred"):
    """The pooled row ('all') and one row per value of ``group`` from a single pass over the predictions.

    Rows collapse to (by, group, label, pred) counts first, so the second grouping level costs nothing.
    """
    cells = df.groupBy(*by, group, F.col(label).alias("_y"), F.col(pred).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"))
    spread = cells.withColumn(group, F.explode(F.array(F.lit("all"), F.col(group).cast("string"))))
    tests = _counts(F.col("_y"), F.col("_p"))
    grouped = spread.groupBy(*by, group).agg(
        *[F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).alias(n) for n, c in tests.items()])
    return _from_counts(grouped, [*by, group])


def _score_steps(df, by, label, score):
    y = F.col(label)
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))


def roc_auc(df, by=(), label="label", score="score"):
    """Area under the ROC curve, ties counted half; NULL when a class is missing.

    Rows collapse to one per distinct score, then the negatives below each score come from a running sum over
    range-partitioned scores, so no task sees a whole group.
    """
    steps = running(_score_steps(df, by, label, score), list(by), ["score"], sums={"neg_to": "neg"})
    below = F.col("neg_to") - F.col("neg") + F.col("neg") / 2
    total = steps.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                                   F.sum(F.col("pos") * below).alias("_wins"))
    return total.select(*by, "n_pos", "n_neg", F.try_divide(
        F.col("_wins").cast("double"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("AUC"))


def roc_points(df, by=(), label="label", score="score"):
    """One point per distinct threshold (flag when score >= threshold), highest first."""
    steps = _score_steps(df, by, label, score).withColumn("_down", -F.col("score"))
    cumulated = running(steps, list(by), ["_down"], sums={"tp": "pos", "fp": "neg"})
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if by:
        joined = cumulated.join(totals, list(by))
    else:
        p, n = totals.first()
        joined = cumulated.withColumns({"_p": F.lit(p), "_n": F.lit(n)})
    return joined.select(*by, F.col("score").alias("threshold"), "tp", "fp", ratio(F.col("tp"), F.col("_p")).alias("tpr"),
                         ratio(F.col("fp"), F.col("_n")).alias("fpr"))


def baselines(df, by=(), label="label"):
    """What no model at all scores: flag everything, flag nothing, always the larger class."""
    y = F.col(label)
    counts = df.groupBy(*by).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
    p, n = F.col("p"), F.col("n")
    return counts.select(
        *by, ratio(p, p + n).alias("all_positive_accuracy"), ratio(2 * p, 2 * p + n).alias("all_positive_f1"),
        ratio(n, p + n).alias("all_benign_accuracy"), ratio(F.greatest(p, n), p + n).alias("majority_accuracy"))


# --- thresholds ---------------------------------------------------------------------------------------------------

def benign_threshold(scores, by=(), fpr=TARGET_FPR, label="label", score="score"):
    """(1 - fpr) quantile of benign scores per group: the threshold that lets a share ``fpr`` of benign rows alarm."""
    return quantiles(scores.where(F.col(label) == 0), list(by), score, 1 - fpr, "threshold")


def other_group_threshold(scores, group, fpr=TARGET_FPR, label="label", score="score"):
    """Per group, the threshold from the benign scores of all other groups, for all groups at once.

    Leaving a group out shifts ranks: with C scores up to a value in all and c of them the group's own, the value of
    rank r among the others is the one of rank r + c in all, where c is what the group has up to its last own score
    with C - c <= r. So one ranked table of distinct scores serves every group. Groups without others have no row.
    """
    p = 1 - fpr
    benign = scores.where((F.col(label) == 0) & F.col(group).isNotNull() & F.col(score).isNotNull())
    counts = materialize(benign.groupBy(group, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n")), "score-counts")
    ranked = materialize(running(counts.groupBy("_s").agg(F.sum("_n").alias("_n")), [], ["_s"], sums={"_all": "_n"}).drop("_n"), "ranked")
    own = running(counts, [group], ["_s"], sums={"_own": "_n"})
    sizes = counts.groupBy(group).agg(F.sum("_n").alias("_size"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))  # one row
    named = scores.where(F.col(group).isNotNull()).select(group).distinct().join(sizes, group, "left")
    at = (F.col("_total") - F.coalesce("_size", F.lit(0)) - 1) * F.lit(float(p))
    ranks = named.join(F.broadcast(total)).where(F.col("_total") > F.coalesce("_size", F.lit(0))).select(
        group, F.floor(at).alias("_low"), F.ceil(at).alias("_high"), (at - F.floor(at)).alias("_part"))

    def shift(rank):
        return F.max(F.when(F.col("_all") - F.col("_own") <= F.col(rank), F.col("_own"))).alias(rank + "_shift")

    moved = own.join(ranked, "_s").join(ranks.select(group, "_low", "_high"), group).groupBy(group).agg(shift("_low"), shift("_high"))
    asked = ranks.join(moved, group, "left").select(group, "_part", F.explode(F.array(*[
        F.struct(F.lit(end).alias("end"), (F.col(end) + F.coalesce(end + "_shift", F.lit(0))).alias("rank")) for end in ("_low", "_high")])).alias("_r"))
    # The smallest score with more than `rank` scores up to it: from the top, the last one met before the rank.
    points = ranked.select((-F.col("_all")).alias("_at"), (-F.col("_s").cast("double")).alias("_less"))
    queries = materialize(asked.select(group, "_part", "_r.end", (-F.col("_r.rank") - 1).alias("_at")), "ranks")
    found = lookup_prefix(points, queries, [], "_at", maxes={"_less_": "_less"})
    low, high = (F.max(F.when(F.col("end") == end, -F.col("_less_"))) for end in ("_low", "_high"))
    return found.groupBy(group).agg((low + (high - low) * F.max("_part")).alias("threshold"))


def halves_by_start(processes, group, start="start"):
    """Mark each process as early or late by its group's median start."""
    at = processes.withColumn("_at", F.unix_micros(start))
    median = quantiles(at, [group], "_at", 0.5, "_median")
    return at.join(median, group, "left").withColumn("late", F.col("_at") > F.col("_median")).drop("_at", "_median")


def earlier_half_threshold(scores, group, fpr=TARGET_FPR):
    """Threshold per group from benign scores of its first half; to be applied to the second half."""
    return benign_threshold(halves_by_start(scores, group).where("NOT late"), [group], fpr)


def apply_threshold(scores, thresholds, by=(), strict=True):
    joined = scores.join(thresholds, list(by), "left") if by else scores.withColumn(
        "threshold", F.lit(thresholds.first()[0]))
    over = F.col("score") > F.col("threshold") if strict else F.col("score") >= F.col("threshold")
    return joined.withColumn("pred", F.when(over, 1).otherwise(0))


def tune_contamination(scores, grid=tuple(round(0.05 * i, 2) for i in range(1, 13)), metric="F1"):
    """Metrics for every flagged share in the grid; take the best row. ``>=`` as in tuning on validation data."""
    limits = quantiles(scores, [], "score", [1 - c for c in grid], "thresholds").first()["thresholds"]
    cells = [F.struct(F.lit(float(c)).alias("contamination"), *[
        F.count_if(test).alias(n) for n, test in _counts(
            F.col("label"), F.when(F.col("score") >= t, 1).otherwise(0)).items()]) for c, t in zip(grid, limits)]
    table = scores.agg(F.array(*cells).alias("_rows")).select(F.explode("_rows").alias("_r")).select("_r.*")
    return _from_counts(table, ["contamination"]).orderBy(F.desc(metric), F.desc("contamination"))


def length_sweep(df, value, label="label", low=-1, high=400, step=5):
    """Accuracy of the one-feature rule `value > t` for every t of the grid.

    Rows collapse to one count per step bucket before the thresholds fan out, so the sweep does not multiply rows.
    """
    v, y = F.coalesce(F.col(value), F.lit(-1)), F.col(label)
    # index of the first t with v <= t
    bucket = F.greatest(F.ceil((v - F.lit(low)) / step), F.lit(0)).cast("int")
    top = (high - 1 - low) // step
    cells = df.groupBy(F.least(bucket, F.lit(top + 1)).alias("b")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    fanned = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(top))))
    right = F.sum(F.when(F.col("b") > F.col("i"), F.col("pos")).otherwise(F.col("neg")))
    return fanned.groupBy("i").agg((right / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy")).select(
        (F.col("i") * step + low).alias("t"), "accuracy")


# --- summaries over folds -----------------------------------------------------------------------------------------

def mean_sd(rows, by, metrics=METRICS):
    present = [m for m in metrics if m in rows.columns]
    return rows.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in present
                                   for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def wins_over_baseline(rows, by, model="Model", baseline="All-positive", metric="F1"):
    """Per model, in how many groups it beats the baseline."""
    base = rows.where(F.col(model) == baseline).select(*by, F.col(metric).alias("_base"))
    others = rows.where(F.col(model) != baseline).join(base, list(by))
    return others.groupBy(model).agg(F.count_if(F.col(metric) > F.col("_base")).alias("wins"),
                                     F.count(F.lit(1)).alias("n"))


def delta_between(rows, by, which, first, second, metrics=("F1", "AUC")):
    """Mean metrics under two variants side by side, and the difference."""
    side = [F.avg(F.when(F.col(which) == v, F.col(m))).alias(f"{v}_{m}") for v in (first, second) for m in metrics]
    wide = rows.groupBy(*by).agg(*side)
    return wide.select("*", *[(F.col(f"{second}_{m}") - F.col(f"{first}_{m}")).alias(m + "_delta") for m in metrics])


def audit_score(sample):
    """Agreement of checked labels overall and per (platform, scenario, label), with its Wilson interval."""
    verdict = F.lower(F.trim("verdict"))
    done = sample.where(verdict.isin("correct", "incorrect", "ambiguous"))
    counts = [F.count(F.lit(1)).alias("checked"), F.count_if(verdict == "correct").alias("correct"),
              F.count_if(verdict == "incorrect").alias("incorrect"),
              F.count_if(verdict == "ambiguous").alias("ambiguous")]
    by = ["platform", "scenario", "label"]
    sets = done.withColumn("label", F.col("label").cast("string")).groupingSets([[], by], *by).agg(
        *counts, F.grouping_id().alias("_g"))
    n = F.col("checked") - F.col("ambiguous")
    low, high = wilson(F.col("correct"), n)
    return sets.select(*[F.when(F.col("_g") > 0, "all").otherwise(F.col(c)).alias(c) for c in by],
                       "checked", "correct", "incorrect", "ambiguous",
                       F.try_divide(F.col("correct").cast("double"), n.cast("double")).alias("agreement"),
                       low.alias("ci95_low"), high.alias("ci95_high"))
