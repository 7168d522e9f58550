"""Alert rule, graph, siblings, matching and neighbours against literal cases and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hosttrace.operators import alerts, audit, encode, graph, metrics, models, network, ordered, splits
from hosttrace.operators.clean import union_runs
from hosttrace.operators.features import prefix_features, process_features, sibling_context
from hosttrace.operators.label import sample_lineage

T0 = 1_767_225_600


def alert_input(spark):
    rows = [(s, s if f else None, y) for s, f, y in
            [(0, 1, 0), (1, 1, 0), (2, 1, 0), (100, 1, 1), (101, 1, 1), (500, 0, 1)]]
    return spark.createDataFrame(rows, "s int, d int, label int").select(
        F.lit("linux").alias("platform"), F.lit("r").alias("run_id"), "label",
        F.timestamp_seconds(F.col("s") + T0).alias("start"), F.timestamp_seconds(F.col("d") + T0).alias("det"))


@pytest.mark.parametrize("least, expected", [(2, (2, 1, 1, 1.0, 1)), (3, (1, 0, 1, None, 0))])
def test_window_rule(spark, least, expected):
    r = alerts.host_alert_summary(alert_input(spark), 60, least).first()
    assert (r.alerts, r.true_alerts, r.false_alarms, r.ttd_s, r.detected) == expected


def greedy(times, window, least):
    last, out = None, []
    for t in sorted(set(times)):
        n = sum(1 for x in times if t - window < x <= t)
        if n >= least and (last is None or t - last >= window):
            last = t
            out.append(t)
    return out


def test_window_rule_random(spark):
    rng = random.Random(7)
    runs = {f"r{i}": [rng.randint(0, span) for _ in range(n)] for i, (n, span) in
            enumerate([(1, 10), (60, 500), (200, 400), (40, 4000)])}
    rows = [("p", r, t * 1_000_000, 0) for r, ts in runs.items() for t in ts]
    df = spark.createDataFrame(rows, "platform string, run_id string, at long, label int")
    for window, least in ((20, 1), (15, 3)):
        got = {}
        for r in alerts.window_alerts(df, window, least).collect():
            got.setdefault(r.run_id, []).append(r["at"] // 1_000_000)
        for run, times in runs.items():
            assert sorted(got.get(run, [])) == greedy(times, window, least)


def walk_root(parent, k):
    seen = set()
    while parent.get(k) in parent and k not in seen:
        seen.add(k)
        k = parent[k]
    return k


def test_topmost_with_cycles(spark):
    rng = random.Random(3)
    parent = {f"n{i}": (f"n{rng.randint(0, i)}" if rng.random() < 0.9 else None) for i in range(1, 60)}
    parent.update({"n0": "gone", "a": "b", "b": "a", "c": "a", "d": "c", "s": "s"})
    parent.update({f"l{i}": f"l{i - 1}" for i in range(1, 40)}, l0=None)
    got = graph.topmost(spark.createDataFrame(list(parent.items()), "node string, parent string"))
    assert {r.node: r.root for r in got.collect()} == {k: walk_root(parent, k) for k in parent}


def walk_depth(parent, image, k, cap=20):
    steps, seen, node = 0, {k}, k
    while steps < cap:
        p = parent[node]
        if not p or p in seen:
            break
        if p not in parent:
            return steps + 1, image[node]
        steps, node = steps + 1, p
        seen.add(p)
    return steps, image[node]


def test_depth_and_root_image(spark):
    parent = {f"l{i}": f"l{i - 1}" for i in range(1, 40)}
    parent.update(l0=None, u="gone", v="u", a="b", b="a", c="a")
    image = {k: "img_" + k for k in parent}
    df = spark.createDataFrame([(k, p, image[k]) for k, p in parent.items()], "node string, parent string, Image string")
    got = {r.node: (r.ancestor_depth, r.root_image) for r in graph.depth_and_root_image(df).collect()}
    assert got == {k: walk_depth(parent, image, k) for k in parent}


def test_closure_literal(spark):
    rows = [("a", "dash", "/tmp/VirusShare_1"), ("b", "a", "/bin/sh"), ("c", "b", "/usr/bin/curl"),
            ("x", "dash", "/usr/sbin/cron"), ("y", "x", "/bin/sh")]
    df = spark.createDataFrame(rows, "ProcessGuid string, ParentProcessGuid string, Image string").withColumns(
        {"platform": F.lit("l"), "run_id": F.lit("r")})
    assert sorted(r.node[-1] for r in sample_lineage(df).collect()) == ["a", "b", "c"]


def siblings(spark, rows):
    df = spark.createDataFrame(rows, "ProcessGuid string, ParentProcessGuid string, s double, Image string").select(
        F.lit("l").alias("platform"), F.lit("r").alias("run_id"), "ProcessGuid", "ParentProcessGuid", "Image",
        F.timestamp_micros(((F.col("s") + T0) * 1e6).cast("long")).alias("start"))
    return {(r.ProcessGuid, r.age_ix): r for r in sibling_context(df).collect()}


def test_siblings_literal(spark):
    got = siblings(spark, [("a", "p", 0.0, "/bin/rm"), ("b", "p", 1.0, "/bin/rm"), ("c", "p", 50.0, "/bin/ls"),
                           ("d", None, 0.0, "/bin/x")])
    at5 = [got[g, 3] for g in "abc"]
    assert [r.b_sib_spawned for r in at5] == [2, 2, 3] and [r.b_sib_same_image for r in at5] == [2, 2, 1]
    assert [r.b_sib_images for r in at5] == [1, 1, 2] and all(r.b_sib_period_cv == -1 for r in at5)
    assert ("d", 3) not in got
    got = siblings(spark, [(g, "p", s, "/usr/bin/curl") for g, s in zip("wxyz", (0.0, 10.0, 20.0, 30.0))])
    assert all(got[g, 8].b_sib_period_cv == 0 and got[g, 8].b_sib_period_s == 10 for g in "wxyz")


def test_siblings_random(spark):
    rng = random.Random(5)
    rows = [(f"g{i:03d}", f"p{rng.randint(0, 2)}", rng.randint(0, 400) / 4, f"/bin/{rng.choice('abc')}")
            for i in range(120)]
    got = siblings(spark, rows)
    for guid, parent, s, image in rows[::7]:
        for ix, age in ((0, 0), (4, 10), (6, 60), (8, 1e7)):
            group = [r for r in rows if r[1] == parent and r[2] <= s + age]
            same = sorted(r[2] for r in group if r[3] == image)
            r = got[guid, ix]
            assert (r.b_sib_spawned, r.b_sib_same_image, r.b_sib_images) == (
                len(group), len(same), len({g[3] for g in group}))
            if len(same) >= 3:
                d = np.diff(same)
                assert r.b_sib_period_s == pytest.approx(d.mean())
                assert r.b_sib_period_cv == pytest.approx(d.std() / d.mean(), abs=1e-9)


def serve(events, flows, window):
    """Log order; an event without a time takes the first flow that is left."""
    used, out = set(), {}
    for e, t in sorted(events.items()):
        near = [(f if t is None else abs(f - t), f, u) for u, f in flows.items()
                if u not in used and (t is None or abs(f - t) <= window)]
        if near:
            d, _, u = min(near)
            used.add(u)
            out[e] = (u, None if t is None else d)
    return out


def matched(spark, keys, **options):
    ev = [("s", k, e, t) for k, (es, _) in keys.items() for e, t in es.items()]
    fl = [("s", k, u, t) for k, (_, fs) in keys.items() for u, t in fs.items()]
    got = network.match_flows(spark.createDataFrame(ev, "session string, fkey string, record_id long, ts double"),
                              spark.createDataFrame(fl, "session string, fkey string, uid string, ts double"), **options).collect()
    found = {r.record_id: (r.uid, r.dt) for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize("slice_rows", [50_000, 5])
def test_flow_matching(spark, slice_rows):
    rng = random.Random(11)
    # Whole seconds bring ties in distance and in time; record numbers do not follow time.
    keys = {}
    for k, (n, m, span, late) in enumerate([(1, 1, 5, 0), (30, 30, 60, 0), (3, 1, 4, 0), (1, 6, 4, 0), (40, 25, 400, 0),
                                            (60, 50, 25, 0), (25, 40, 30, 4), (3, 2, 50, 3), (0, 2, 5, 1), (0, 0, 5, 2)]):
        ids = rng.sample(range(k * 1000, k * 1000 + 999), n + late)
        draw = rng.uniform if k % 2 else rng.randint
        times = [float(draw(0, span)) for _ in range(n)] + [None] * late
        keys[f"k{k}"] = dict(zip(ids, times)), {f"C{k}_{i}": float(draw(0, span)) for i in range(m)}
    expected = {}
    for es, fs in keys.values():
        expected.update(serve(es, fs, 3.0))
    assert matched(spark, keys, window=3.0, slice_rows=slice_rows) == expected


def test_flow_matching_chain(spark):
    # Every event stands on a flow, but the first of the log takes the first flow: all others move on by one.
    n = 60
    events = {0: 0.4} | {i + 1: float(i) for i in range(n)}
    flows = {f"C{i:03}": float(i) for i in range(n + 1)}
    keys = {"hot": (events, flows), "far": ({1000: 5.0, 1001: 5.0, 1002: 900.0}, {"F1": 890.0, "F2": 1.0})}
    expected = serve(events, flows, 100.0) | serve(*keys["far"], 100.0)
    assert matched(spark, keys, window=100.0, slice_rows=8) == expected


def test_running_spans_chunks(spark):
    rows = [("hot", i, 1) for i in range(3000)] + [(f"k{i}", 0, 5) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t int, v long")
    out = ordered.running(df, ["k"], ["t"], sums={"s": "v"}, maxes={"m": "t"})
    assert all(r.s == r["t"] + 1 and r.m == r["t"] for r in out.where("k = 'hot'").collect())
    lag = ordered.lag_of(df, ["k"], ["t"], "t", "prev").where("k = 'hot' AND t > 0")
    assert lag.where("prev <> t - 1 OR prev IS NULL").count() == 0


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    data = {k: rng.integers(0, 40, n).astype(float) for k, n in (("a", 1), ("b", 2), ("c", 333))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.quantile for r in ordered.quantiles(df, ["k"], "v", q).collect()}
        assert got == pytest.approx({k: np.quantile(vs, q) for k, vs in data.items()})


def test_roc_literal(spark):
    score, y = [0.95, 0.90, 0.80, 0.65, 0.55, 0.40, 0.30, 0.10], [1, 1, 0, 1, 0, 1, 0, 0]
    df = spark.createDataFrame(list(zip(y, score)), "label int, score double")
    wins = sum(a > b for (a, i), (b, j) in itertools.product(zip(score, y), zip(score, y)) if i == 1 and j == 0)
    assert metrics.roc_auc(df).first().AUC == pytest.approx(wins / 16)
    points = [(r.tpr, r.fpr) for r in metrics.roc_points(df).orderBy(F.desc("threshold")).collect()]
    assert points == [(.25, 0), (.5, 0), (.5, .25), (.75, .25), (.75, .5), (1, .5), (1, .75), (1, 1)]


def test_group_folds(spark):
    df = spark.range(2000).select((F.col("id") % 97).alias("g"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    folded = splits.stratified_group_folds(df, "g")
    assert splits.overlapping_groups(folded, "g").count() == 0
    assert folded.select("fold").distinct().count() == 5


def test_encoder(spark):
    rows = [("x", "n%d" % i, i, "-") for i in range(30)] + [("y", None, None, "-")]
    df = spark.createDataFrame(rows, "few string, many string, num int, empty string")
    enc = encode.EventEncoder().fit(df)
    assert enc.kinds == {"few": "cat", "many": "strlen", "num": "numeric"}
    new = spark.createDataFrame([("y", "abc", 4), ("new", None, None)], "few string, many string, num int")
    assert [tuple(r) for r in enc.transform(new).collect()] == [(1.0, 3.0, 4.0), (-1.0, -1.0, -1.0)]


def brute_lof(train, test, k):
    def near(x, drop=None):
        d = np.sqrt(((train - x) ** 2).sum(1))
        order = [i for i in np.argsort(d, kind="stable") if i != drop][:k]
        return order, d[order]
    fit = [near(x, i) for i, x in enumerate(train)]
    kd = np.array([d[-1] for _, d in fit])
    lrd = np.array([1 / (np.maximum(d, kd[i]).mean() + 1e-10) for i, d in fit])
    out = []
    for x in test:
        i, d = near(x)
        out.append(lrd[i].mean() * (np.maximum(d, kd[i]).mean() + 1e-10))
    return np.array(out)


def test_lof_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    train, test = rng.normal(size=(150, 3)), rng.normal(scale=2, size=(40, 3))

    def frame(x):
        return spark.createDataFrame([tuple(map(float, r)) + (i,) for i, r in enumerate(x)], "a double, b double, c double, i int")

    fitted = models.fit_lof(frame(train), ["a", "b", "c"], k=5)
    got = np.array([r.score for r in models.score_lof(fitted, frame(test)).orderBy("i").collect()])
    assert got == pytest.approx(brute_lof(train, test, 5), rel=1e-6)


def test_nearest_points_count_copies(spark):
    df = spark.createDataFrame([(0.0,)] * 4 + [(1.0,), (5.0,)], "a double")
    points = models.distinct_vectors(df, ["a"])
    assert points.count() == 3
    near = models.nearest_points(points.select(F.col("pid").alias("qid"), "v"), points, 3, block_rows=2, same_points=True)
    total = near.groupBy("qid").agg(F.sum("weight").alias("w"), F.max("d").alias("d")).join(
        points.withColumnRenamed("pid", "qid"), "qid")
    assert {r.v[0]: (r.w, r.d) for r in total.collect()} == {0.0: (3, 0.0), 1.0: (3, 1.0), 5.0: (3, 5.0)}


def test_isolation_forest_finds_outlier(spark):
    df = spark.createDataFrame([(float(i % 10), float(i % 7)) for i in range(400)], "a double, b double")
    forest = models.fit_isolation_forest(df, ["a", "b"], trees=30)
    probe = spark.createDataFrame([(5.0, 3.0), (60.0, -40.0)], "a double, b double")
    inner, outer = [r.score for r in models.score_isolation_forest(forest, probe).collect()]
    assert outer > inner + 0.1


def test_deep_chain(spark):
    """Far deeper than any round limit: doubling needs a dozen rounds."""
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(1500)] + [("a", "b"), ("b", "a")]
    got = {r["node"]: (r["root"], r["dist"]) for r in graph.topmost(spark.createDataFrame(rows, "node string, parent string")).collect()}
    assert all(got[f"n{i}"] == ("n0", i) for i in range(1500)) and got["a"] == ("a", 0)


def hot_events(spark, n=3000):
    """One process holds nine tenths of the events; some rows lack the sequence number, some the time."""
    rows = [(None if i % 50 == 7 else i, "linux", "r", "{hot}" if i % 10 else "{%d}" % (i // 10), 1 if i % 97 == 0 else 11,
             None if i % 201 == 5 else T0 + i, f"/tmp/f{i % 700}.txt", "c" * (i % 13 + 1)) for i in range(n)]
    return spark.createDataFrame(rows, "record_id long, platform string, run_id string, ProcessGuid string, EventID int, s long, "
                                 "TargetFilename string, CommandLine string").select(
        "*", F.timestamp_seconds("s").alias("UtcTime"), *[F.lit(None).cast("string").alias(c) for c in (
            "ParentProcessGuid", "ParentCommandLine", "DestinationIp", "DestinationPort", "TargetObject", "Device", "Image")], F.lit(0).alias("label"))


def test_hot_process_is_dealt_before_it_is_aggregated(spark):
    rows = prefix_features(hot_events(spark))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") >= 1
    got = rows.where("ProcessGuid = '{hot}'").orderBy("age_ix").collect()
    dated = [i for i in range(3000) if i % 10 and i % 201 != 5]
    start = min(dated)
    for r, age in zip(got, [0, 1, 2, 5, 10, 30, 60, 300, 10 ** 9]):
        seen = [i for i in dated if i - start <= age]
        assert r["n_events"] == len(seen) and r["n_files"] == len({i % 700 for i in seen})


def test_features_without_sequence_numbers(spark):
    """Without any sequence number the first value is the earliest one."""
    e = hot_events(spark).where("s IS NOT NULL")
    with_numbers = {r["ProcessGuid"]: r["cmd_len"] for r in process_features(e.withColumn("record_id", F.col("s"))).collect()}
    without = {r["ProcessGuid"]: r["cmd_len"] for r in process_features(e.withColumn("record_id", F.lit(None).cast("long"))).collect()}
    assert without == with_numbers and all(v > 0 for v in without.values())


def test_union_checks_schemas(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    with pytest.raises(ValueError, match="other columns"):
        union_runs([a, a.drop("y")])
    assert union_runs([a, a.drop("y")], ["x"]).count() == 2


def test_merge_verdict_and_severity(spark):
    e = spark.createDataFrame([("a", 1, 1), ("a", 3, 1), ("b", 1, 0)], "platform string, EventID int, label int")
    got = {r["reason"]: r["value"] for r in audit.merge_verdict(e, "a", "b", platform_accuracy=0.99).collect()}
    assert got == {"label_share_gap": 100.0, "one_sided_event_ids": 1.0, "platform_predictable": 0.99}
    flags = spark.createDataFrame([("h1", "T1082 x"), ("h1", "T1083 y"), ("h2", ""), ("h3", "T1105 z"), ("h4", "T1082 x"), ("h4", "T1083 y"), ("h4", "T1087 z")],
                                  "host string, technique string")
    got = {r["host"]: (r["severity"], r["n_flagged"]) for r in alerts.alert_severity(flags, ["host"]).collect()}
    assert got == {"h1": ("low", 2), "h2": ("medium", 1), "h3": ("high", 1), "h4": ("high", 3)}


def _walk(edges, seeds):
    below, new = set(seeds), set(seeds)
    while new:
        new = {c for c, p in edges if p in new} - below
        below |= new
    return below


def test_descendants_of_random_graphs(spark):
    rng = random.Random(3)
    for size, parents in ((40, 1), (60, 3), (200, 1), (200, 2)):
        edges = [(f"n{rng.randrange(size)}", f"n{rng.randrange(size + 10)}") for _ in range(int(size * (0.8 + 0.3 * parents)))]
        if parents == 1:  # a forest and some cycles
            edges = list(dict(edges).items())
        edges += [(None, "n1"), ("n1", None)]
        seeds = ["n1", "n7", "alone", None]
        got = graph.descendants(spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame([(s,) for s in seeds], "s string"))
        names = [r.node for r in got.collect()]
        assert sorted(names) == sorted(_walk([e for e in edges if None not in e], seeds[:3]))
    none = graph.descendants(spark.createDataFrame([], "child string, parent string"), spark.createDataFrame([("x",)], "s string"))
    assert [r.node for r in none.collect()] == ["x"]


def test_descendants_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: rounds.append(name) or plain(df, name))
    edges = spark.range(1, 10_001).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    got = graph.descendants(edges, spark.createDataFrame([(0,)], "s long"))
    assert got.count() == 10_001 and rounds.count("below") <= 16


def test_other_group_thresholds(spark):
    rng = random.Random(8)
    rows = [(g, rng.randrange(30) / 10, int(rng.random() < 0.2)) for g, n in (("a", 200), ("b", 3), ("c", 50), ("d", 1)) for _ in range(n)]
    rows += [("only attacks", 9.0, 1), (None, 8.0, 0), ("a", None, 0)]
    scores = spark.createDataFrame(rows, "g string, score double, label int")
    for fpr in (0.05, 0.5, 0.0, 1.0):
        got = {r.g: r.threshold for r in metrics.other_group_threshold(scores, "g", fpr).collect()}
        expected = {g: np.quantile([s for h, s, y in rows if y == 0 and h not in (g, None) and s is not None], 1 - fpr) for g in {r[0] for r in rows} - {None}}
        assert got == pytest.approx(expected)
    assert metrics.other_group_threshold(scores.limit(0), "g").collect() == []
    assert metrics.other_group_threshold(scores.where("g = 'a'"), "g").collect() == []


def test_alert_grid_runs_side_by_side(spark, monkeypatch):
    """Two points of the grid are under way at once, and each row carries its own point."""
    import threading
    from hosttrace.operators import alerts
    both = threading.Barrier(2)

    def summary(processes, window_s, least):
        both.wait(60)
        return processes.select(F.lit(window_s * 10 + least).alias("mark"))

    monkeypatch.setattr(alerts, "host_alert_summary", summary)
    found = alerts.alert_grid(spark.range(1), (60, 300), (1, 2)).collect()
    assert sorted((r.W, r.N) for r in found) == [(60, 1), (60, 2), (300, 1), (300, 2)] and all(r.mark == r.W * 10 + r.N for r in found)
