"""Evaluation protocols: folds are columns, fits are Spark jobs, predictions of all folds are measured together.

``rows`` is a process table (see ``plans.etl.process_table``): feature columns, label, platform, run_id, ProcessGuid,
session, scenario, lineage. Driver loops run over folds, models and features, never over rows.
"""

from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hosttrace.operators import alerts, encode, metrics, models, splits
from hosttrace.operators.features import AGES
from hosttrace.session import materialize, side_by_side

ID = ["platform", "run_id", "ProcessGuid", "label"]
ATTACK_RUN = "NOT startswith(session, 'benign')"
BENIGN_RUN = "startswith(session, 'benign')"


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _tagged(df, **tags):
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def _fitted(jobs):
    """Models of (train, columns, classifier), options of ``fit_classifier`` behind them, fitted side by side."""
    return side_by_side(jobs[0][0].sparkSession, [partial(models.fit_classifier, *job) for job in jobs]) if jobs else []


def _scored(model, test, *columns):
    """Written scores. A model lies in the closure of its tasks, so each of them would take in all models of one plan."""
    return materialize(models.score_classifier(model, test).select(*columns), "scored")


def _supervised_part(train, test, columns, name, classifier):
    scored = _scored(models.fit_classifier(train, columns, classifier), test, *ID, "score", "pred")
    return _tagged(scored, Model=name, Type="Supervised")


def benign_detectors(train, columns, group="lineage", seed=0, trees=200, lof=True, fpr=metrics.TARGET_FPR):
    """{name: (score function, threshold)} of the anomaly detectors.

    They see benign training rows only: 80 % of the lineages to fit, the rest for the threshold at the target rate.
    """
    benign = splits.group_shuffle(train.where("label = 0"), group, 0.2, seed)
    fit, held = benign.where("NOT is_test").drop("is_test"), benign.where("is_test").drop("is_test")
    scaled = lambda df: encode.standardise(fit, [df], columns)[0]
    forest = models.fit_isolation_forest(scaled(fit), columns, trees, seed)
    scorers = {"Isolation Forest": lambda df: models.score_isolation_forest(forest, scaled(df))}
    if lof:
        fitted = models.fit_lof(scaled(fit), columns)
        scorers["Local Outlier Factor"] = lambda df: models.score_lof(fitted, scaled(df))
    return {name: (score, metrics.benign_threshold(materialize(score(held).select("label", "score"), "calibration"),
                                                   fpr=fpr).first()[0]) for name, score in scorers.items()}


def anomaly_predictions(train, test, columns, **options):
    out = []
    for name, (score, limit) in benign_detectors(train, columns, **options).items():
        scored = score(test).withColumn("pred", F.when(F.col("score") > F.lit(limit), 1).otherwise(0))
        out.append(_tagged(scored.select(*ID, "score", "pred"), Model=name, Type="Anomaly"))
    return _union(out)


def all_positive(test):
    return _tagged(test.select(*ID).withColumns({"score": F.lit(None).cast("double"), "pred": F.lit(1)}),
                   Model="All-positive", Type="Baseline")


def evaluate_each(parts, columns, classifiers=None, anomaly=True, **options):
    """Predictions of all detectors and the flag-everything baseline for every (train, test, tags).

    All fits of all parts are independent and run side by side.
    """
    calls, tags = [], []
    for train, test, tag in parts:
        part = [partial(_supervised_part, train, test, columns, *named) for named in (classifiers or models.supervised()).items()]
        part.append(partial(all_positive, test))
        if anomaly:
            part.append(partial(anomaly_predictions, train, test, columns, **options))
        calls, tags = calls + part, tags + [tag] * len(part)
    return _union([_tagged(found, **tag) for found, tag in zip(side_by_side(parts[0][0].sparkSession, calls), tags)])


def evaluate(train, test, columns, classifiers=None, anomaly=True, **options):
    return evaluate_each([(train, test, {})], columns, classifiers, anomaly, **options)


def report(predictions, by=("Type", "Model")):
    """Metric rows pooled and per platform, AUC included, from one prediction table."""
    by = list(by)
    rows = metrics.pooled_and_by(predictions, "platform", by)
    spread = predictions.withColumn("platform", F.explode(F.array(F.lit("all"), F.col("platform"))))
    auc = metrics.roc_auc(spread, [*by, "platform"]).select(*by, "platform", "AUC")
    return rows.join(auc, [*by, "platform"], "left").withColumnRenamed("platform", "Platform")


# --- the four protocols -------------------------------------------------------------------------------------------

def lineage_cv(rows, columns, k=5, repeats=5, **options):
    """Repeated stratified k-fold over lineages: no lineage on both sides."""
    parts = []
    for r in range(repeats):
        folded = materialize(splits.stratified_group_folds(rows, "lineage", k=k, seed=r), "folds")
        for f in range(k):
            hit = F.col("fold") == f
            parts.append((folded.where(~hit), folded.where(hit), {"Repeat": r, "Fold": f}))
    return evaluate_each(parts, columns, **options)


def leave_one_out(rows, columns, held, **options):
    """Hold out every attack run, scenario, machine or repetition in turn."""
    return evaluate_each([(train, test, {"HeldOut": str(value)})
                          for value, train, test in splits.leave_one_out(rows, held, ATTACK_RUN)], columns, **options)


def independent_runs(rows, columns, new_runs, **options):
    """Train on the original runs, test on runs collected later: all together and one by one."""
    new = F.col("run_id").isin(list(new_runs))
    parts = {"all new runs": new, **{r: F.col("run_id") == r for r in new_runs}}
    # The training rows are the same for every part, so each detector is fitted once, on all new rows, and the parts
    # select from its predictions, which carry the run.
    found = materialize(evaluate(rows.where(~new), rows.where(new), columns, **options), "new")
    return _union([_tagged(found.where(hit), HeldOut=name) for name, hit in parts.items()])


def random_process_split(rows, columns, repeats=5, **options):
    """The process-level random split, to show how much the split alone changes."""
    each = [splits.group_shuffle(rows, "ProcessGuid", 0.3, seed=r) for r in range(repeats)]
    return evaluate_each([(split.where("NOT is_test"), split.where("is_test"), {"Repeat": r}) for r, split in enumerate(each)], columns, **options)


def cross_group(rows, columns, group, pairs, **options):
    """Train on one platform, machine or repetition, test on another."""
    return evaluate_each([(rows.where(F.col(group) == a), rows.where(F.col(group) == b), {"train": str(a), "test": str(b)})
                          for a, b in pairs], columns, **options)


def zero_day(train, test, columns, group="run_id", k=3, classifier=None, fpr=metrics.TARGET_FPR, **options):
    """Forest at 0.5, forest at the benign threshold from out-of-fold scores, outlier factor, and either of the two.

    Returns predictions per detector; thresholds are per platform.
    """
    classifier = classifier or models.supervised()["Random Forest"]
    folded = materialize(splits.stratified_group_folds(train, group, k=k), "folds")
    *of_folds, whole = _fitted([(part, columns, classifier) for part in [*[folded.where(F.col("fold") != f) for f in range(k)], train]])
    oof = _union(side_by_side(train.sparkSession, [partial(_scored, model, folded.where(F.col("fold") == f), "platform", "label", "score")
                                                   for f, model in enumerate(of_folds)]))
    limit = metrics.benign_threshold(oof, ["platform"], fpr)
    forest = models.score_classifier(whole, test).select(*ID, "score")
    forest = materialize(forest, "forest")
    at_half = forest.withColumn("pred", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    at_fpr = metrics.apply_threshold(forest, limit, ["platform"], strict=False).drop("threshold")
    lof = anomaly_predictions(train, test, columns, group=group, fpr=fpr, **options).where(
        F.col("Model") == "Local Outlier Factor").drop("Model", "Type")
    lof = materialize(lof, "lof")
    either = at_fpr.select(*ID, F.col("pred").alias("a")).join(
        lof.select(*ID[:3], F.col("pred").alias("b")), ID[:3]).select(
        *ID, F.lit(None).cast("double").alias("score"), F.greatest("a", "b").alias("pred"))
    return _union([_tagged(d, detector=n) for n, d in
                   {"rf@0.5": at_half, "rf@fpr5": at_fpr, "lof": lof, "rf|lof": either}.items()])


# --- sensitivity and importance -----------------------------------------------------------------------------------

def label_flip(rows, columns, flipped, k=5, seed=0, **options):
    """The same folds under the original labels and with the given process keys turned to 1."""
    folded = splits.stratified_group_folds(rows, "lineage", k=k, seed=seed)
    marks = flipped.select(*ID[:3], F.lit(True).alias("_flip")).distinct()
    both = materialize(folded.join(marks, ID[:3], "left").withColumn("_flip", F.coalesce("_flip", F.lit(False))), "flip")
    parts = []
    for name, y in (("original", F.col("label")), ("flipped", F.when(F.col("_flip"), 1).otherwise(F.col("label")))):
        labelled = both.withColumn("label", y)
        for f in range(k):
            hit = F.col("fold") == f
            parts.append((labelled.where(~hit), labelled.where(hit), {"Labels": name, "Fold": f}))
    return evaluate_each(parts, columns, anomaly=False, **options)


def ablation(rows, subsets, k=5, seed=0, **options):
    """The same folds under several feature subsets."""
    folded = materialize(splits.stratified_group_folds(rows, "lineage", k=k, seed=seed), "folds")
    calls = [(name, columns, f, partial(evaluate, folded.where(F.col("fold") != f), folded.where(F.col("fold") == f), columns, anomaly=False, **options))
             for name, columns in subsets.items() for f in range(k)]
    found = side_by_side(rows.sparkSession, [call for *_, call in calls])
    return _union([_tagged(part, Subset=name, Fold=f) for part, (name, _, f, _) in zip(found, calls)])


def _f1(model, test):
    return metrics.confusion_metrics(models.score_classifier(model, test)).first()["F1"]


def _fit_f1(train, test, columns, classifier, **options):
    return float(_f1(models.fit_classifier(train, columns, classifier, **options), test))


def importance(train, test, columns, classifier=None, repeats=5, keys=("platform", "run_id", "ProcessGuid")):
    """Impurity importance and the mean F1 drop when a feature is shuffled among the test rows: (feature, impurity, drop).

    All features and repeats are scored in one pass over the copies, of which only counts are shuffled. A copy equal to its
    row keeps the row's prediction, so only copies with another value are scored.
    """
    model = models.fit_classifier(train, columns, classifier or models.supervised()["Random Forest"])
    test = _scored(model, test.select(*keys, "label", *columns), *keys, "label", *columns, "pred")
    base, impurity = metrics.confusion_metrics(test).first()["F1"], dict(models.impurity_importance(model, columns))
    copies, point = models.permuted_copies(test, columns, keys, repeats), ["feature", "repeat", "label", "pred"]
    anew = models.score_classifier(model, copies.where("moved").drop("pred")).select(*point)
    found = metrics.confusion_metrics(copies.where("NOT moved").select(*point).unionByName(anew), ["feature", "repeat"])
    drops = dict(found.groupBy("feature").agg(F.avg(F.lit(base) - F.col("F1"))).collect())  # one row a feature
    rows = sorted(((c, float(impurity[c]), float(drops[c])) for c in columns), key=lambda r: -r[2])
    return train.sparkSession.createDataFrame(rows, "feature string, impurity double, f1_drop double")


def backward_elimination(train, valid, order, classifier=None, tolerance=0.01):
    """F1 with the k best features for every k, and the smallest set within ``tolerance`` of the best."""
    classifier = classifier or models.small_forest()
    sizes = range(len(order), 0, -1)
    found = side_by_side(train.sparkSession, [partial(_fit_f1, train, valid, order[:k], classifier) for k in sizes])
    curve = list(zip(sizes, found))
    best = max(f for _, f in curve)
    smallest = min(k for k, f in curve if f >= best * (1 - tolerance))
    table = train.sparkSession.createDataFrame(curve, "k int, f1 double")
    return table.withColumn("smallest", F.col("k") == smallest), order[:smallest]


def component_search(train, valid, columns, most=30, classifier=None):
    """Validation F1 for every number of principal components.

    Components are nested, so scaler and components are fitted once, on the training rows, for the largest number.
    """
    classifier, most = classifier or models.small_forest(), min(most, len(columns))
    rotation = Pipeline(stages=models.preparation(columns, components=most)).fit(train)
    names = [f"pc_{i}" for i in range(most)]

    def rotated(df):
        values = vector_to_array("features")
        return materialize(rotation.transform(df).select("label", *[values[i].alias(n) for i, n in enumerate(names)]), "components")

    train, valid = rotated(train), rotated(valid)
    sizes = range(1, most + 1)
    found = side_by_side(train.sparkSession, [partial(_fit_f1, train, valid, names[:n], classifier, scale=False) for n in sizes])
    curve = list(zip(sizes, found))
    return train.sparkSession.createDataFrame(curve, "components int, f1 double").orderBy(F.desc("f1"), "components")


def platform_leak(train, test, columns, margin=0.03, least=6, classifier=None, most=30):
    """Drop the most platform-predictive feature until platforms cannot be told apart better than by guessing.

    Rows (dropped, n_features, platform_accuracy, f1), one per step.
    """
    classifier = classifier or models.small_forest()

    def as_platform(df):
        return df.withColumn("label", F.when(F.col("platform") == "windows", 1).otherwise(0))

    a, b = materialize(as_platform(train), "platform"), materialize(as_platform(test), "platform")
    majority = metrics.baselines(b).first()["majority_accuracy"]
    kept, dropped, steps = list(columns), "-", []
    for _ in range(most):
        model, by_label = _fitted([(a, kept, classifier), (train, kept, classifier)])
        accuracy = metrics.confusion_metrics(models.score_classifier(model, b)).first()["Accuracy"]
        f1 = _f1(by_label, test)
        steps.append((dropped, len(kept), float(accuracy), float(f1)))
        if accuracy <= majority + margin or len(kept) <= least:
            break
        dropped = models.impurity_importance(model, kept)[0][0]
        kept.remove(dropped)
    return train.sparkSession.createDataFrame(
        steps, "dropped string, n_features int, platform_accuracy double, f1 double"), kept


def top_overlap(train, columns, classifier=None, k=15):
    """Features among the k most important both for the label and for the platform."""
    classifier = classifier or models.small_forest()
    named = train.withColumn("_y", F.when(F.col("platform") == "windows", 1).otherwise(0))
    tops = [[c for c, _ in models.impurity_importance(models.fit_classifier(df, columns, classifier), columns)[:k]]
            for df in (train, named.withColumn("label", F.col("_y")))]
    return [c for c in tops[0] if c in tops[1]]


# --- early detection ----------------------------------------------------------------------------------------------

def age_scores(train, test, columns, classifier=None, variant="full"):
    """Scores of the test processes at every age. ``full`` trains on finished processes, ``prefix`` on all ages.

    Both inputs have one row per (process, age_ix). A process is the same at every age until its next event, so with all
    ages most training rows are equal to others and are merged for the fit.
    """
    whole = len(AGES) - 1
    fit = train if variant == "prefix" else train.where(F.col("age_ix") == whole)
    classifier = classifier or models.supervised()["Random Forest"]
    if variant == "prefix" and models.uses_every_row(classifier):
        model = models.fit_merged(fit, columns, classifier)
    else:
        model = models.fit_classifier(fit, columns, classifier, scale=False)
    return models.score_classifier(model, test)


def rates_by_age(scores, threshold=0.5):
    flagged = F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)
    return scores.groupBy("age_ix").agg(F.avg(F.when(F.col("label") == 1, flagged)).alias("Recall"),
                                        F.avg(F.when(F.col("label") == 0, flagged)).alias("FPR"))


def early_detection(scores, events, threshold=0.5, k=1):
    """(detections, incidents, false alarms) of one score table."""
    found = materialize(alerts.first_detection(scores, AGES, threshold), "detections")
    lineage = scores.select(*ID[:3], "lineage").distinct()
    named = found.join(lineage, ID[:3])
    return found, alerts.incidents(named, k), alerts.false_alarms(named, alerts.run_hours(events), k)


def _age_scores_written(train, test, columns, classifier):
    scores = age_scores(train, test, columns, classifier, "prefix")
    return materialize(scores.select(*ID, "age_ix", "score", "start", "end"), "scored")


def benign_curve(rows, events, columns, classifier=None, threshold=0.9, window_s=60, least=2):
    """False alarms on one held-out benign run against the number of other benign runs in training.

    Only fits are a loop, over runs; the scores of all of them are measured together. Without benign runs in training
    one model serves every held-out run.
    """
    benign = splits.held_out_values(rows, "run_id", BENIGN_RUN)
    attack, run, calls, points = F.expr(ATTACK_RUN), F.col("run_id"), [], []
    for n in range(len(benign)):
        for held in benign if n else [None]:
            others = [r for r in benign if r != held][:n]
            test = rows.where(run == held if n else run.isin(benign))
            calls.append(partial(_age_scores_written, rows.where(attack | run.isin(others)), test, columns, classifier))
            points.append(n)
    out = [scores.withColumns({"held_out": run, "benign_runs_in_train": F.lit(n)})
           for scores, n in zip(side_by_side(rows.sparkSession, calls), points)]
    point = ["held_out", "benign_runs_in_train"]
    scores = materialize(_union(out), "scores")
    found = materialize(alerts.first_detection(scores, AGES, threshold, [*point, *ID[:3]]), "detections")
    summary = alerts.host_alert_summary(found, window_s, least, [*point, "platform", "run_id"])
    return summary.join(alerts.run_hours(events), ["platform", "run_id"]).withColumn(
        "fa_per_hour", F.try_divide(F.col("false_alarms").cast("double"), F.col("hours")))


# --- scoring new data ---------------------------------------------------------------------------------------------

def score_new(model, rows, columns, threshold=0.5, strict=False, trained_on=None):
    """Score unseen rows: missing features count 0; ``seen_in_training`` marks ids the model was trained on."""
    filled = rows.withColumns({c: F.lit(0.0) for c in columns if c not in rows.columns}).fillna(0.0, columns)
    scored = models.score_classifier(model, filled)
    over = F.col("score") > threshold if strict else F.col("score") >= threshold
    scored = scored.withColumn("pred", F.when(over, 1).otherwise(0))
    if trained_on is None:
        return scored
    ids = trained_on.select("platform", "ProcessGuid", F.lit(True).alias("seen_in_training")).distinct()
    return scored.join(ids, ["platform", "ProcessGuid"], "left").fillna(False, ["seen_in_training"])


def export_holdout(rows, columns, path, train_value, group="machine", classifier=None):
    """Train on one group, save, reload, and check that the reloaded model predicts the other group the same.

    Returns (reloaded model, predictions). Raises if a process is on both sides or a prediction differs.
    """
    train, test = rows.where(F.col(group) == train_value), rows.where(F.col(group) != train_value)
    if not train.join(test.select(*ID[:3]), ID[:3], "left_semi").isEmpty():
        raise ValueError("a process is in training and in test")
    model = models.fit_classifier(train, columns, classifier or models.supervised()["Random Forest"])
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    first = materialize(models.score_classifier(model, test).select(*ID, "score", "pred"), "predictions")
    second = models.score_classifier(again, test).select(*ID, "score", "pred")
    if not first.exceptAll(second).isEmpty():
        raise ValueError("the reloaded model predicts differently")
    return again, first
