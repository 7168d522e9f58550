"""Models and protocols: invariants on separable data."""

import threading
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hosttrace.operators import models
from hosttrace.plans import protocols

COLUMNS = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(
        F.when(F.col("id") % 2 == 0, "linux").otherwise("windows").alias("platform"),
        F.concat(F.lit("run"), (F.col("id") % 6).cast("string")).alias("run_id"),
        F.concat(F.lit("g"), F.col("id").cast("string")).alias("ProcessGuid"),
        (F.col("id") % 5 == 0).cast("int").alias("label"), F.lit("trojan").alias("session"),
        (F.floor(F.col("id") / 3)).cast("string").alias("lineage"), (F.col("id") % 2 + 1).alias("machine"),
        F.randn(1).alias("noise"), F.randn(2).alias("b0"))
    return df.withColumns({"a": F.col("label") * 4 + F.col("noise") / 4, "b": F.col("b0")}).drop("b0").persist()


def test_export_round_trip(rows, tmp_path):
    model, predictions = protocols.export_holdout(rows, COLUMNS, str(tmp_path / "m"), 1, classifier=models.small_forest(5, 4))
    assert predictions.where("label <> pred").count() <= 3 and predictions.count() == 300
    new = rows.where("machine = 2").drop("noise")
    strict = protocols.score_new(model, new, COLUMNS, threshold=1.0, strict=True, trained_on=rows.where("machine = 1"))
    assert strict.where("pred = 1").count() == 0 and strict.where("seen_in_training").count() == 0


def test_report_and_baseline(rows):
    found = protocols.evaluate(rows.where("machine = 1"), rows.where("machine = 2"), COLUMNS,
                               {"Random Forest": models.small_forest(5, 4)}, anomaly=False)
    got = {(r.Model, r.Platform): r for r in protocols.report(found).collect()}
    assert got["Random Forest", "all"].AUC > 0.95 and got["All-positive", "all"].Recall == 1.0
    assert got["All-positive", "all"].Accuracy == pytest.approx(0.2)


def test_permuted_copies(rows):
    """In every copy one column is a permutation of itself; the others stay."""
    some = rows.select("platform", "run_id", "ProcessGuid", "label", "a", "b")
    copies = models.permuted_copies(some, ["a", "b"], ["platform", "run_id", "ProcessGuid"], 2).persist()
    assert copies.count() == 600 * 2 * 2
    for r in range(2):
        one = copies.where((F.col("repeat") == r) & (F.col("feature") == "a"))
        assert one.select("a").exceptAll(some.select("a")).isEmpty()
        assert one.select("ProcessGuid", "label", "b").exceptAll(some.select("ProcessGuid", "label", "b")).isEmpty()
        assert one.join(some.withColumnRenamed("a", "was"), "ProcessGuid").where("a <> was").count() > 500


def test_importance_finds_the_signal(rows):
    found = protocols.importance(rows.where("machine = 1"), rows.where("machine = 2"), COLUMNS, models.small_forest(5, 4), repeats=3)
    got = {r.feature: r.f1_drop for r in found.collect()}
    assert found.first().feature == "a" and got["a"] > 0.4 and abs(got["noise"]) < 0.1 and abs(got["b"]) < 0.1


def test_benign_detectors_hold_the_rate(rows):
    found = protocols.benign_detectors(rows, COLUMNS, trees=20, lof=False)
    score, limit = found["Isolation Forest"]
    rate = score(rows.where("label = 0")).agg(F.avg((F.col("score") > limit).cast("int"))).first()[0]
    assert rate < 0.2


def test_elimination_finds_the_signal(rows):
    curve, kept = protocols.backward_elimination(rows.where("machine = 1"), rows.where("machine = 2"), ["a", "noise", "b"],
                                                 models.small_forest(5, 4))
    assert kept == ["a"] and curve.count() == 3


def test_benign_curve(rows):
    """Without benign rows in training everything is flagged; with them no false alarm is left."""
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.substring("ProcessGuid", 2, 9).cast("int"))
    runs = rows.withColumns({"session": F.when(F.col("run_id").isin("run0", "run2", "run4"), "benign").otherwise("trojan"), "start": at, "end": at, "age_ix": F.lit(0)})
    runs = runs.withColumn("label", F.when(F.col("session") == "benign", 0).otherwise(1)).withColumn("a", F.when(F.col("label") == 1, 4.0).otherwise(F.col("noise") / 4))
    events = runs.select("platform", "run_id", F.col("start").alias("UtcTime"))
    got = protocols.benign_curve(runs, events, ["a"], models.small_forest(5, 4)).collect()
    assert sorted((r.held_out, r.benign_runs_in_train) for r in got) == [(f"run{k}", n) for k in (0, 2, 4) for n in range(3)]
    assert all(r.held_out == r.run_id and r.attack_run == 0 for r in got)
    assert all((r.false_alarms > 0) == (r.benign_runs_in_train == 0) for r in got)


def test_isolation_trees_share_few_rows(rows):
    few = rows.where("label = 0").limit(100)
    forest = models.fit_isolation_forest(few, COLUMNS, trees=10)
    assert [t["size"][0] for t in forest["trees"]] == [100] * 10
    far = rows.limit(1).withColumns({"a": F.lit(50.0), "b": F.lit(50.0), "noise": F.lit(50.0)})
    high = models.score_isolation_forest(forest, far).first()["score"]
    assert high > models.score_isolation_forest(forest, few).agg(F.avg("score")).first()[0] + 0.1


def test_deep_trees_keep_node_ids(rows):
    """Every forest keeps each row's node on the executors; the trees are those that come without."""
    forests = [c for c in models.supervised().values() if c.hasParam("cacheNodeIds")] + [models.small_forest()]
    assert len(forests) == 3 and all(c.getCacheNodeIds() for c in forests)
    typer = models.fit_typer(rows.where("label = 1"), COLUMNS, target="platform", trees=3)
    assert typer.stages[-2].getCacheNodeIds()
    forest = models.supervised()["Random Forest"]
    forest.setNumTrees(5)
    kept, sent = models.fit_classifier(rows, COLUMNS, forest), models.fit_classifier(rows, COLUMNS, forest.copy({forest.cacheNodeIds: False}))
    trees = [m.stages[-1].toDebugString.split("\n", 1)[1] for m in (kept, sent)]
    assert trees[0] == trees[1]


def test_equal_rows_are_merged(spark, monkeypatch):
    """Rows equal over the ages reach the forest as few copies, and the trees are those grown on all of them."""
    k, sizes = F.col("id"), F.array(*map(F.lit, (1, 4, 9, 18, 36, 72)))
    each = spark.range(240).select((k * 7 % 13).cast("double").alias("a"), (k * 5 % 11).cast("double").alias("b"),
                                   (k * 37 % 101).cast("double").alias("noise"), (k % 2).cast("int").alias("label"),
                                   F.element_at(sizes, (F.floor(k / 2) % 6 + 1).cast("int")).alias("n"))
    rows = each.withColumn("age_ix", F.explode(F.sequence(F.lit(1), "n"))).persist()
    forest = models.supervised()["Random Forest"]
    forest.setNumTrees(5)
    fit, seen = type(forest).fit, []
    monkeypatch.setattr(type(forest), "fit", lambda self, data: seen.append(data.count()) or fit(self, data))
    alone, merged = models.fit_classifier(rows, COLUMNS, forest, scale=False), models.fit_merged(rows, COLUMNS, forest)
    assert seen[0] == 5600 and seen[1] <= 1640
    assert merged.stages[-1].totalNumNodes == alone.stages[-1].totalNumNodes > 50
    one, other = ({tuple(r[:3]): r[3] for r in models.score_classifier(m, each).select(*COLUMNS, "score").collect()} for m in (alone, merged))
    assert len(one) == 240 and all(abs(score - other[k]) < 1e-9 for k, score in one.items())
    scores = protocols.age_scores(rows, rows, COLUMNS, forest, variant="prefix")
    assert seen[2] <= 1640 and scores.count() == 5600
    # Trees on drawn rows would be others: they meet all rows.
    protocols.age_scores(rows, rows, COLUMNS, models.small_forest(2, 3), variant="prefix")
    assert seen[3:] == [5600]
    # However many rows are equal, none stands for more of them than a distinct row does on average.
    uneven = each.select(*COLUMNS, "label", F.lit(1.0).alias("weight")).withColumn(
        "n", F.when(F.expr("a + b + noise = 0"), 10_000).otherwise(10)).withColumn("c", F.explode(F.sequence(F.lit(1), "n"))).drop("n", "c")
    most, total = models.merge_equal(uneven, 9).agg(F.max("weight"), F.sum("weight")).first()
    assert 10 < most <= 12_390 / 240 and abs(total - 12_390) < 1e-6


def test_fits_run_side_by_side(rows, monkeypatch):
    """Fits of different folds overlap; new runs share one fit, and each part holds its own rows."""
    fit, fits, both = models.fit_classifier, [], threading.Barrier(2)

    def meeting(*job, **options):
        fits.append(job)
        both.wait(60)  # passes once two fits are under way
        return fit(*job, **options)

    monkeypatch.setattr(models, "fit_classifier", meeting)
    forest = {"Random Forest": models.small_forest(3, 3)}
    found = protocols.lineage_cv(rows, COLUMNS, k=2, repeats=1, classifiers=forest, anomaly=False)
    assert len(fits) == 2 and found.where("Model = 'Random Forest'").count() == 600
    monkeypatch.setattr(models, "fit_classifier", lambda *job, **options: fits.append(job) or fit(*job, **options))
    new = protocols.independent_runs(rows, COLUMNS, ["run1", "run2"], classifiers=forest, anomaly=False)
    counts = {(r.HeldOut, r.Model): r["count"] for r in new.groupBy("HeldOut", "Model").count().collect()}
    assert len(fits) == 3 and all(counts[h, "Random Forest"] == n for h, n in (("all new runs", 200), ("run1", 100), ("run2", 100)))


def test_block_search_in_little_memory():
    """Nearest points of a full block, worked out a few queries at a time; the same rows as all distances at once."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20_000, 64))
    points = pd.DataFrame({"pid": np.arange(len(v)), "v": list(v), "weight": 1})
    queries = pd.DataFrame({"qid": np.arange(300), "v": list(v[:300])})
    tracemalloc.start()
    found = models._block_top(20)(None, queries, points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    nearest = found.sort_values(["qid", "d"]).groupby("qid").head(20)
    for q, rows in list(nearest.groupby("qid"))[::50]:
        want = np.sort(np.sqrt(((v - v[q]) ** 2).sum(1)))[:20]
        assert np.allclose(rows["d"], want) and rows["pid"].iloc[0] == q
