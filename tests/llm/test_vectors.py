"""Clusters and embedding near-duplicates against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest

from hosttrace.llm import orchard_clusters, pruned_graph, queries
from hosttrace.llm.common import table

from .data import empty

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, u string, node long, cluster string, VEC_IDS int, w int"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, p, "x", 1, "c", 2, 3) for i, v, p in rows], SCHEMA).repartition(3)


def noisy(seed, base, spread):
    r = random.Random(seed)
    return [x + spread * r.gauss(0, 1) for x in base]


def direction(seed, dims):
    r = random.Random(seed)
    v = [r.gauss(0, 1) for _ in range(dims)]
    return [x / math.sqrt(sum(y * y for y in v)) for x in v]


def hard(dims):
    """Nulls, other lengths, zeros, non-finite and repeated rows among plain ones."""
    bad = [None, [], [1.0] * (dims - 1), [0.0] * dims, [math.nan] + [1.0] * (dims - 1), [math.inf] * dims, [None] + [1.0] * (dims - 1)]
    rows = [(1000 + k, v, 1) for k, v in enumerate(bad)]
    rows += [(k, noisy(k, direction(k % 5, dims), 0.05 / math.sqrt(dims) * (k % 7)), k % 3) for k in range(120)]
    same = direction(99, dims)
    return rows + [(7, same, 1), (7, same, 1), (2000, same, 1), (2001, [2 * x for x in same], 1), (2002, same, None), (2003, same, 2), (None, same, 1), (None, direction(98, dims), 1)]


def to_float(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


# ---------------------------------------------------------------- clusters

def plain_clusters(rows, dims, k, rounds, seed=3, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, g in groups.items():
            centroids[n] = [sum(column) // len(g) for column in zip(*g)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    total = sum(d for _, _, d in found)
    within = {n: sum(d for _, m, d in found if m == n) for _, n, _ in found}
    return [(i, n, d, within[n], total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found]


@pytest.mark.parametrize("k, scale", [(8, 1024), (30, 1024), (12, 2)])
def test_clusters_equal_plain_lloyd(spark, k, scale):
    dims = 6
    rows = [(i, to_float(v), p) for i, v, p in hard(dims)]
    got = orchard_clusters.cluster(embeddings(spark, rows), centroids=k, rounds=6, dims=dims, scale=scale)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_clusters(rows, dims, k, 6, scale=scale)))


def test_orchard_search_finds_the_smallest_of_ties():
    r = np.random.default_rng(5)
    for k in (1, 2, 7, 40):
        c = r.integers(-3, 4, (k, 2))  # many equal centroids and equal distances
        x = r.integers(-5, 6, (500, 2))
        best, d = orchard_clusters.Neighbours(c).nearest(x)
        plain = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (d == plain.min(axis=1)).all() and (best == plain.argmin(axis=1)).all()


def test_clusters_of_empty_and_few_and_huge(spark):
    frame = embeddings(spark, hard(6))
    assert orchard_clusters.cluster(empty(frame), dims=6).collect() == []
    assert orchard_clusters.cluster(frame.where("vec_id = 1001"), dims=6).collect() == []
    few = [(1, [1.0, 2.0], 0), (2, [-1.5, 0.0], 0)]
    assert sorted(map(tuple, orchard_clusters.cluster(embeddings(spark, few), dims=2).collect())) == sorted(plain_clusters(few, 2, 8, 10))
    with pytest.raises(Exception, match="exceeds"):
        orchard_clusters.cluster(embeddings(spark, [(1, [1e30, 0.0], 0)]), dims=2).collect()


def test_cluster_query_equals_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op11_orchard_clusters']})").fetchall()
    got = queries.op11_orchard_clusters(spark, SF_DIR)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) == 500


# ---------------------------------------------------------------- near-duplicates

def plain_links(rows, similarity=0.98):
    unit = []
    for i, v, p in rows:
        ok = v and p is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / max(map(abs, v)) if ok else None)
    unit = [None if u is None else u / np.sqrt(u @ u) for u in unit]
    n, label = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity:
                n[i] += 1
                n[j] += 1
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    first = {}
    for (i, _, _), c in zip(rows, label):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    return [(i, n[k], first.get(c), i is not None and i == first.get(c)) for k, ((i, _, _), c) in enumerate(zip(rows, label))]


@pytest.mark.parametrize("region, shard", [(4096, 512), (24, 8)])
def test_links_equal_all_pairs(spark, region, shard, monkeypatch):
    monkeypatch.setattr(pruned_graph, "REGION", region)
    monkeypatch.setattr(pruned_graph, "SHARD", shard)
    monkeypatch.setattr(pruned_graph, "QUERIES", 50)
    monkeypatch.setattr(pruned_graph, "TARGET", 1.0)
    rows = [(i, to_float(v), p) for i, v, p in hard(16)]
    rows += [(5000 + k, to_float(noisy(k, direction(500, 16), 0.035)), 2) for k in range(90)]  # a hot group of near copies
    got = pruned_graph.near_duplicates(embeddings(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_links(rows)))


def test_vectors_that_centres_cannot_part(spark, monkeypatch):
    """Different vectors that round to one direction's dots are split by number and all met."""
    monkeypatch.setattr(pruned_graph, "REGION", 16)
    monkeypatch.setattr(pruned_graph, "SHARD", 8)
    base = direction(1, 8)
    rows = [(k, [x * (1 + 1e-15 * k) if d == 0 else x for d, x in enumerate(base)], 1) for k in range(70)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = pruned_graph.near_duplicates(frame).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(69, 0)} and len(got) == 70


def test_last_effort_is_exact_and_weak_efforts_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(pruned_graph, "REGION", 64)
    rows = [(k, to_float(noisy(k, direction(k % 3, 12), 0.05)), 1) for k in range(300)]
    frame = embeddings(spark, rows)
    monkeypatch.setattr(pruned_graph, "efforts", lambda dims: [(1.0, None)])
    assert sorted(map(tuple, pruned_graph.near_duplicates(frame).collect())) == sorted(plain_links(rows))
    tried = []
    whole = pruned_graph.audit

    def noted(*a, **k):
        tried.append(whole(*a, **k))
        return tried[-1]
    monkeypatch.setattr(pruned_graph, "audit", noted)
    monkeypatch.setattr(pruned_graph, "efforts", lambda dims: [(0.0, 1), (1.0, None)])
    assert sorted(map(tuple, pruned_graph.near_duplicates(frame).collect())) == sorted(plain_links(rows))
    assert len(tried) == 2 and tried[0] < pruned_graph.TARGET and tried[1] == 1.0


def test_empty_near_duplicates(spark):
    frame = embeddings(spark, hard(6))
    assert pruned_graph.near_duplicates(empty(frame)).collect() == []
    assert [tuple(r) for r in pruned_graph.near_duplicates(frame.where("vec_id = 1001")).collect()] == [(1001, 0, 1001, True)]


def test_graph_query_covers_its_table(spark):
    rows = [tuple(r) for r in table(spark, SF_DIR, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = queries.op13_pruned_graph(spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(plain_links(rows))
