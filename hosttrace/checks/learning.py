"""Models and protocols on process features and on the given embeddings."""

import uuid

from pyspark.sql import functions as F

from hosttrace.checks.registry import check, r6, rounded
from hosttrace.checks.telemetry import table, telemetry_table
from hosttrace.operators import features, models, splits
from hosttrace.plans import etl, protocols
from hosttrace.schema import PROCESS_FEATURES
from hosttrace.session import materialize, scratch_dir

_rows = {}
WITHOUT_COMMANDS = [c for c in PROCESS_FEATURES if c not in ("cmd_len", "pcmd_len")]


def _forest():
    return {"Random Forest": models.supervised()["Random Forest"]}


def forget():
    """Let the next query write its own process table."""
    _rows.clear()


def process_rows(spark, sf):
    """Process table of the telemetry, written once per session; the machine is the host the process ran on."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _rows:
        rows = etl.process_table(telemetry_table(spark, sf))
        hosts = telemetry_table(spark, sf).groupBy("platform", "run_id", "ProcessGuid").agg(
            F.min("computer").alias("machine"))
        _rows[key] = materialize(rows.join(hosts, ["platform", "run_id", "ProcessGuid"]), "processes")
    return _rows[key]


def _split(spark, sf):
    rows = splits.group_shuffle(process_rows(spark, sf), "lineage")
    return rows.where("NOT is_test").drop("is_test"), rows.where("is_test").drop("is_test")


def _scored(name):
    def run(spark, sf):
        train, test = _split(spark, sf)
        scored = models.score_classifier(models.fit_classifier(train, PROCESS_FEATURES, models.supervised()[name]), test)
        return scored.select("platform", "run_id", "ProcessGuid", "label", "score", "pred")
    return run


for _id, _name in (("m10_naive_bayes", "Naive Bayes"), ("m11_decision_tree", "Decision Tree"),
                   ("m12_random_forest", "Random Forest"), ("m13_linear_svm", "Linear SVM")):
    check(_id)(_scored(_name))


@check("m5_principal_components")
def m5(spark, sf):
    train, test = _split(spark, sf)
    return protocols.component_search(train, test, PROCESS_FEATURES)


@check("m14_isolation_forest")
def m14(spark, sf):
    train, test = _split(spark, sf)
    forest = models.fit_isolation_forest(train.where("label = 0"), PROCESS_FEATURES)
    return models.score_isolation_forest(forest, test).select("platform", "run_id", "ProcessGuid", "label", "score")


@check("m15_nearest_distances", f"""
SELECT vec_id, {r6('max(d)', 'k_distance')} FROM (SELECT a.vec_id, list_distance(CAST(a.embedding AS DOUBLE[]),
    CAST(b.embedding AS DOUBLE[])) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d) AS r
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r <= 20 GROUP BY vec_id""")
def m15(spark, sf):
    emb = table(spark, sf, "embeddings")
    points = models.distinct_vectors(emb, "embedding")
    near = models.nearest_points(points.select(F.col("pid").alias("qid"), "v"), points, 20, same_points=True)
    distance = near.groupBy("qid").agg(F.max("d").alias("k_distance"))
    named = emb.withColumn("qid", F.xxhash64(F.transform("embedding", lambda x: x.cast("double"))))
    return rounded(named.join(distance, "qid").select("vec_id", "k_distance"))


_D = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@check("m15_local_outlier_factor", f"""
WITH fit AS (SELECT * FROM embeddings WHERE label < 5),
nf AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS p, {_D} AS d, row_number() OVER (PARTITION BY a.vec_id
       ORDER BY {_D}) AS r FROM fit a JOIN fit b ON a.vec_id <> b.vec_id) WHERE r <= 20),
kd AS (SELECT q AS p, max(d) AS kd FROM nf GROUP BY q),
lrd AS (SELECT q AS p, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nf JOIN kd USING (p) GROUP BY q),
nt AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS p, {_D} AS d, row_number() OVER (PARTITION BY a.vec_id
       ORDER BY {_D}) AS r FROM embeddings a JOIN fit b ON true) WHERE r <= 20)
SELECT q AS vec_id, {r6('avg(lrd) * (avg(greatest(d, kd)) + 1e-10)', 'score')}
FROM nt JOIN kd USING (p) JOIN lrd USING (p) GROUP BY q""")
def m15_lof(spark, sf):
    emb = table(spark, sf, "embeddings")
    fitted = models.fit_lof(emb.where("label < 5"), "embedding")
    return rounded(models.score_lof(fitted, emb).select("vec_id", "score"))


@check("m16_attack_types")
def m16(spark, sf):
    train, test = _split(spark, sf)
    typer = models.fit_typer(train.where("label = 1"), PROCESS_FEATURES)
    return models.type_of(typer, test.where("label = 1")).select("ProcessGuid", "scenario", "attack_type",
                                                                 "type_confidence")


@check("m24_lineage_cv")
def m24_p1(spark, sf):
    return protocols.report(materialize(protocols.lineage_cv(
        process_rows(spark, sf), PROCESS_FEATURES, k=5, repeats=1, lof=False), "cv"))


@check("m24_leave_one_scenario_out")
def m24_p3(spark, sf):
    rows = materialize(protocols.leave_one_out(process_rows(spark, sf), PROCESS_FEATURES, "scenario", anomaly=False), "loso")
    return protocols.report(rows, ["HeldOut", "Model"])


@check("m24_independent_runs")
def m24_p4(spark, sf):
    return protocols.report(materialize(protocols.independent_runs(
        process_rows(spark, sf), PROCESS_FEATURES, ["run_29", "run_30"], anomaly=False), "new"), ["HeldOut", "Model"])


@check("m24_random_process_split")
def m24_random(spark, sf):
    return protocols.report(materialize(protocols.random_process_split(process_rows(spark, sf), PROCESS_FEATURES, 1, anomaly=False), "random"))


@check("m25_rates_by_age")
def m25(spark, sf):
    rows = materialize(features.prefix_features(telemetry_table(spark, sf)).join(
        process_rows(spark, sf).select("platform", "run_id", "ProcessGuid", "label", "lineage"),
        ["platform", "run_id", "ProcessGuid"]), "ages")
    split = splits.group_shuffle(rows, "lineage")
    return protocols.rates_by_age(protocols.age_scores(
        split.where("NOT is_test"), split.where("is_test"), PROCESS_FEATURES, variant="prefix"))


@check("m27_cross_platform")
def m27(spark, sf):
    pairs = [("linux", "windows"), ("windows", "linux")]
    rows = protocols.cross_group(process_rows(spark, sf), PROCESS_FEATURES, "platform", pairs, anomaly=False)
    return protocols.report(materialize(rows, "cross"), ["train", "test", "Model"])


@check("m27_cross_machine")
def m27_machine(spark, sf):
    rows = protocols.cross_group(process_rows(spark, sf), PROCESS_FEATURES, "machine", [("host0", "host1"), ("host1", "host0")])
    return protocols.report(materialize(rows, "cross"), ["train", "test", "Model"])


@check("m27_cross_repetition")
def m27_repetition(spark, sf):
    """The first recordings of every scenario against the second."""
    rows = process_rows(spark, sf)
    starts = telemetry_table(spark, sf).groupBy("platform", "session", "run_id").agg(F.min("UtcTime").alias("start"))
    numbered = splits.repetition_numbers(starts).select("platform", "run_id", "rep")
    rows = materialize(rows.join(numbered, ["platform", "run_id"]), "repetitions")
    return protocols.report(materialize(protocols.cross_group(rows, PROCESS_FEATURES, "rep", [(1, 2), (2, 1)]), "cross"), ["train", "test", "Model"])


@check("m24_leave_one_run_out")
def m24_p2(spark, sf):
    rows = protocols.leave_one_out(process_rows(spark, sf), PROCESS_FEATURES, "run_id", classifiers=_forest(), anomaly=False)
    return protocols.report(materialize(rows, "loro"), ["HeldOut", "Model"])


@check("m26_benign_curve")
def m26(spark, sf):
    events = telemetry_table(spark, sf)
    rows = features.prefix_features(events).join(
        process_rows(spark, sf).select("platform", "run_id", "ProcessGuid", "label", "lineage", "session", F.col("machine").alias("computer")),
        ["platform", "run_id", "ProcessGuid"])
    span = events.groupBy("platform", "run_id", "ProcessGuid").agg(F.min("UtcTime").alias("start"), F.max("UtcTime").alias("end"))
    rows = rows.join(span, ["platform", "run_id", "ProcessGuid"])
    return protocols.benign_curve(materialize(rows, "ages"), events, PROCESS_FEATURES, models.small_forest())


@check("m34_holdout_export")
def m34(spark, sf):
    """A model of one machine, saved, loaded and compared, on the processes of the others."""
    rows = process_rows(spark, sf)
    _, predictions = protocols.export_holdout(rows, PROCESS_FEATURES, f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}", "host0")
    return predictions


@check("m27_zero_day")
def m27_zero(spark, sf):
    rows = process_rows(spark, sf)
    hit = F.col("scenario") == "trojan"
    found = protocols.zero_day(rows.where(~hit), rows.where(hit), PROCESS_FEATURES, k=5)
    return protocols.report(materialize(found, "zero"), ["detector"])


@check("m28_label_flip")
def m28(spark, sf):
    rows = process_rows(spark, sf)
    found = protocols.label_flip(rows, PROCESS_FEATURES, rows.where("label = 0 AND n_events >= 6"), classifiers=_forest())
    return protocols.report(materialize(found, "flip"), ["Labels", "Model"])


@check("m29_ablation")
def m29(spark, sf):
    found = protocols.ablation(process_rows(spark, sf), {"all": PROCESS_FEATURES, "no_cmd": WITHOUT_COMMANDS}, classifiers=_forest())
    return protocols.report(materialize(found, "ablation"), ["Subset", "Model"])


@check("m30_importance")
def m30(spark, sf):
    train, test = _split(spark, sf)
    return protocols.importance(train, test, PROCESS_FEATURES)


@check("m31_backward_elimination")
def m31(spark, sf):
    train, test = _split(spark, sf)
    return protocols.backward_elimination(train, test, PROCESS_FEATURES)[0]


@check("m32_platform_leak")
def m32(spark, sf):
    train, test = _split(spark, sf)
    return protocols.platform_leak(train, test, PROCESS_FEATURES)[0]


@check("m33_score_new_rows")
def m33(spark, sf):
    train, test = _split(spark, sf)
    model = models.fit_classifier(train, PROCESS_FEATURES, models.supervised()["Random Forest"])
    return protocols.score_new(model, test.drop("rate"), PROCESS_FEATURES, trained_on=train).select(
        "platform", "ProcessGuid", "score", "pred", "seen_in_training")
