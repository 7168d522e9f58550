"""Forests from counted binned rows against Spark's own trees."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from hosttrace.operators import forest, metrics, models
from hosttrace.plans import protocols

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    df = spark.range(4000).select(F.floor(F.rand(1) * 40).alias("a"), F.floor(F.randn(2) * 3).cast("double").alias("b"),
                                  (k * 37 % 25 - 9).cast("double").alias("c"), F.rand(3).alias("r"))
    df = df.withColumn("label", F.when(F.col("a") + F.col("c") > 20 + 9 * F.col("r"), 2).when(F.col("r") + F.col("c") / 9 > 0.9, 1).otherwise(0))
    return df.withColumn("a", F.col("a").cast("double")).drop("r").persist()


def _trees(model):
    return model.stages[-1].toDebugString.split("\n", 1)[1]


@pytest.mark.parametrize("settings", [{"impurity": "gini", "maxDepth": 30, "minInstancesPerNode": 9}, {"impurity": "entropy", "maxDepth": 4},
                                      {"maxDepth": 0}, {"maxBins": 4, "maxDepth": 4, "minInstancesPerNode": 60}])
@pytest.mark.parametrize("most", [1, 2])
def test_trees_are_spark_trees(rows, monkeypatch, settings, most):
    """Where every feature is looked at and every row is met, nothing is drawn and the trees are the same up to equal gains."""
    some = rows.withColumn("label", F.least("label", F.lit(most)))
    classifier = forest.BinnedForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=2, bootstrap=False,
                                               featureSubsetStrategy="all", seed=0, **settings)
    grown = models.fit_classifier(some, COLUMNS, classifier, scale=False)
    monkeypatch.setattr(forest.BinnedForestClassifier, "_grown", lambda self, data: None)
    plain = models.fit_classifier(some, COLUMNS, classifier, scale=False)
    assert type(grown.stages[-1]) is type(plain.stages[-1])
    one, other = (models.score_classifier(m, some).select("score").toPandas()["score"].to_numpy() for m in (grown, plain))
    if settings["maxDepth"] < 9:
        assert _trees(grown) == _trees(plain) and np.allclose(one, other)
        assert np.allclose(grown.stages[-1].featureImportances.toArray(), plain.stages[-1].featureImportances.toArray(), atol=1e-6)
    else:  # small nodes have splits of equal gain, of which sums of another order choose another
        assert abs(grown.stages[-1].totalNumNodes / plain.stages[-1].totalNumNodes - 1) < 0.05 and (np.abs(one - other) < 1e-9).mean() > 0.8
        assert np.allclose(grown.stages[-1].featureImportances.toArray(), plain.stages[-1].featureImportances.toArray(), atol=0.01)


def test_drawn_rows_and_features(rows, tmp_path):
    """Trees on drawn rows differ from each other, predict as well as Spark's, and are saved and read like any forest."""
    classifier = models.small_forest(30, 8)
    plain = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=30, maxDepth=8, minInstancesPerNode=1, seed=0)
    right = []
    for c in (classifier, plain):
        model = models.fit_classifier(rows, COLUMNS, c)
        right.append(models.score_classifier(model, rows).agg(F.avg((F.col("pred") == F.col("label")).cast("int"))).first()[0])
    assert abs(right[0] - right[1]) < 0.02 and right[0] > 0.8
    model = models.fit_classifier(rows, COLUMNS, classifier)
    trees = model.stages[-1].trees
    assert len({t.toDebugString.split("\n", 1)[1] for t in trees}) == 30
    model.write().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert _trees(again) == _trees(model) and again.stages[-1].getNumTrees == 30


def test_counts_stand_for_rows():
    """A tree on rows with counts is the tree on the rows one by one, whatever the blocks that are counted at once."""
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 5, (300, 4)).astype(np.uint8)
    y, n = (bins[:, 0] + rng.integers(0, 3, 300) > 3).astype(np.int32), rng.integers(1, 6, 300)
    points, spec = [np.arange(4) + 0.5] * 4, {"classes": 2, "drawn": 2, "least": 4, "impurity": "gini", "depth": 9, "bootstrap": False}
    grow = lambda *rows: forest.grow_tree(*rows, None, np.array([1.0, 2.0]), points, spec, np.random.default_rng(7))
    one, all_ = grow(bins, y, n), grow(np.repeat(bins, n, 0), np.repeat(y, n), np.ones(n.sum(), int))
    assert len(one["left"]) > 9 and all(np.array_equal(one[c], all_[c]) for c in one)
    saved = forest.LEVEL_ROWS, forest.LEVEL_CELLS
    try:
        forest.LEVEL_ROWS, forest.LEVEL_CELLS = 7, 50
        again = grow(bins, y, n)
    finally:
        forest.LEVEL_ROWS, forest.LEVEL_CELLS = saved
    assert all(np.array_equal(one[c], again[c]) for c in one)


def test_a_deep_fit_takes_no_more_passes(rows, spark):
    """Deep trees run the jobs of shallow ones: before, a forest ran at least one more for every level."""
    context, jobs = spark.sparkContext, []
    for depth in (2, 30):
        context.setJobGroup(f"forest-{depth}", "fit")
        try:
            model = models.fit_classifier(rows, COLUMNS, models.supervised()["Random Forest"].setMaxDepth(depth), scale=False)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    assert max(t.depth for t in model.stages[-1].trees) > 8 and 0 < jobs[1] <= jobs[0] + 4


def test_more_rows_than_a_table_holds(rows, monkeypatch):
    """Beyond the bound, and for settings not met here, Spark's own trees serve."""
    monkeypatch.setattr(forest, "TABLE_ROWS", 10)
    found = models.fit_classifier(rows, COLUMNS, models.small_forest(2, 3))
    assert found.stages[-1].totalNumNodes > 2 and not found.stages[-1].uid.startswith("dtc")


def test_importance_scores_what_moved(rows, monkeypatch):
    """Copies equal to their row are not scored again, and every drop is the one of scoring them all."""
    some = rows.withColumns({"id": F.monotonically_increasing_id(), "label": F.least("label", F.lit(1)), "flat": F.lit(0.0)}).persist()
    columns, score, seen, kept = [*COLUMNS, "flat"], models.score_classifier, [], []
    monkeypatch.setattr(models, "score_classifier", lambda model, df: (seen.append(df), kept.append(model), score(model, df))[-1])
    got = {r.feature: r.f1_drop for r in protocols.importance(some, some, columns, models.small_forest(5, 6), 2, ["id"]).collect()}
    copies = models.permuted_copies(some.select("id", "label", *columns), columns, ["id"], 2)
    assert seen[-1].count() < 0.75 * copies.count() == 0.75 * 4000 * 4 * 2 and seen[-1].where("feature = 'flat'").isEmpty()
    base = metrics.confusion_metrics(score(kept[0], some)).first()["F1"]
    want = metrics.confusion_metrics(score(kept[0], copies), ["feature", "repeat"]).groupBy("feature").agg(F.avg(base - F.col("F1")).alias("d"))
    assert all(abs(got[r.feature] - r.d) < 1e-9 for r in want.collect()) and got["flat"] == 0 and got["a"] > 0.1
