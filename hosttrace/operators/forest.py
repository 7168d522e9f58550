"""Random forests grown from binned rows: one table of distinct rows, dealt whole to the tasks that grow the trees.

Spark's forests pass over all rows for every level and every batch of nodes. Here rows are cut at the same candidate split
points (Spark's rule, on a sample of the same size) and rows that fall between the same points are counted once; a row is
then a byte for each feature and a count. A task holds that table and grows its share of the trees, a level at a time,
from counts of (node, bin, class). The trees follow Spark's rules: the features drawn for a node, the least number of rows
in a leaf, gain, depth, Poisson counts of drawn rows, and leaves of one prediction merged. They are written in Spark's own
layout and read by its reader, so the fitted model is a ``RandomForestClassificationModel`` like any other.

A table of more than ``TABLE_ROWS`` distinct rows, or a setting that is not met here, goes to Spark's own trees.
"""

import json
import time

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hosttrace.session import materialize, scratch_path

SPLIT_ROWS = 10_000     # rows from which candidate split points are taken, the number that Spark's trees take
TABLE_ROWS = 8_000_000  # distinct rows that a task holds; a byte a feature and some 16 more each, twice
PACK_ROWS = 20_000      # rows that travel as one value
LEVEL_ROWS = 500_000    # rows whose counts are taken at once
LEVEL_CELLS = 4_000_000  # counts at hand at once
NODES = 50_000          # nodes that a task hands on at once

_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
_NODE = "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, " \
        "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"


def split_points(values, weights, expected, most):
    """At most ``most`` candidate split points of one column, chosen from a sample as Spark's trees choose them.

    They lie between distinct values, at about equal shares of the expected weight; what other values leave of it is zero's.
    """
    at, place = np.unique(values[values != 0], return_inverse=True)
    held = np.bincount(place, weights[values != 0], minlength=len(at))
    rest = expected - held.sum()
    if len(at) and rest > 1e-6:
        zero = np.searchsorted(at, 0.0)
        at, held = np.insert(at, zero, 0.0), np.insert(held, zero, rest)
    between = (at[1:] + at[:-1]) / 2
    if len(between) <= most:
        return between
    points, target, reached = [], expected / (most + 1), np.cumsum(held)
    for i in range(len(between)):
        if abs(reached[i] - target) < abs(reached[i + 1] - target):
            points.append(between[i])
            target += expected / (most + 1)
    return np.array(points)


# ---------------------------------------------------------------- the table

def _binned(points):
    def run(batches):
        for batch in batches:
            n, f = batch.num_rows, len(points)
            if not n:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, f)
            if not np.isfinite(x).all():
                raise ValueError("features must be finite numbers")  # as Spark's trees have it
            bins = np.empty((n, f), np.uint8)
            for k, p in enumerate(points):
                bins[:, k] = np.searchsorted(p, x[:, k])  # a value equal to its point goes to the left
            at = pa.py_buffer(np.arange(0, (n + 1) * f, f, dtype=np.int32)) if f else pa.py_buffer(np.zeros(n + 1, np.int32))
            yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(bins)]),
                                              batch.column(1), batch.column(2)], ["bins", "label", "weight"])
    return run


def _packed(batches):
    """Rows as few values: (bins, label, weight, n) of ``PACK_ROWS`` rows, one array of bytes each."""
    names = ["bins", "label", "weight", "n"]
    kinds = [None, np.int32, np.float64, np.int64]
    for batch in batches:
        for at in range(0, batch.num_rows, PACK_ROWS):
            part = batch.slice(at, PACK_ROWS)
            cells = [b"".join(part.column(0).to_pylist())] + [
                part.column(k).to_numpy(zero_copy_only=False).astype(kinds[k]).tobytes() for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names)


# ---------------------------------------------------------------- one tree

def _impurity(stats, kind):
    total = np.maximum(stats.sum(-1, keepdims=True), 1e-300)
    p = stats / total
    if kind == "gini":
        return 1 - (p * p).sum(-1)
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(-1)


def _counts(bins, y, n, w, start, feature, size, classes):
    """Counts and weights (node, bin, class) of one drawn feature a node; rows lie in the order of their nodes."""
    m, cells = len(start) - 1, size * classes
    raw = np.zeros(m * cells)
    held = raw if w is None else np.zeros(m * cells)
    width = bins.shape[1]
    flat = bins.reshape(-1)
    node = np.repeat(np.arange(m), np.diff(start))
    for a in range(start[0], start[-1], LEVEL_ROWS):
        b = min(a + LEVEL_ROWS, start[-1])
        own = node[a - start[0]:b - start[0]]
        value = flat[np.arange(a * width, b * width, width) + feature[own]]
        key = own * cells + value * np.int64(classes) + y[a:b]
        raw += np.bincount(key, n[a:b], m * cells)
        if w is not None:
            held += np.bincount(key, n[a:b] * w[a:b], m * cells)
    return raw.reshape(m, size, classes), held.reshape(m, size, classes)


def _best(raw, held, per_class, least, kind):
    """(gain, bin) of the best split of each node on one feature; gain is minus infinity where no split is allowed."""
    left_n, left = raw.sum(-1).cumsum(1), (held if per_class is None else held * per_class).cumsum(1)
    total_n, total = left_n[:, -1:], left[:, -1:]
    left_n, left = left_n[:, :-1], left[:, :-1]
    right = total - left
    lw, rw, tw = left.sum(-1), right.sum(-1), total.sum(-1)
    gain = _impurity(total, kind) - lw / tw * _impurity(left, kind) - rw / tw * _impurity(right, kind)
    # Rounded, so that equal gains are equal however the weights were added up; the first of them counts.
    gain = np.where((left_n >= least) & (total_n - left_n >= least), gain.round(12), -np.inf)
    best = gain.argmax(1)
    return gain[np.arange(len(gain)), best], best


def grow_tree(bins, y, n, w, per_class, points, spec, rng):
    """The nodes of one tree in order of their levels, as columns; children follow their parents.

    ``n`` counts the rows that are equal, ``w`` is their weight, or None if ``per_class`` gives it.
    """
    classes, drawn, least, kind = spec["classes"], spec["drawn"], spec["least"], spec["impurity"]
    size, f = max((len(p) for p in points), default=0) + 1, len(points)
    splits = np.array([len(p) for p in points])
    n = (rng.poisson(n) if spec["bootstrap"] else n).astype(float)
    if spec["bootstrap"]:
        some = n > 0
        bins, y, n, w = bins[some], y[some], n[some], None if w is None else w[some]
    stats = np.bincount(y, n if w is None else n * w, classes)[None] * (1.0 if per_class is None else per_class)
    levels, start, raw = [], np.array([0, len(y)]), np.array([n.sum()])
    first = 0  # id of the level's first node
    for depth in range(spec["depth"] + 1):
        m = len(stats)
        level = {"stats": stats, "raw": raw, "impurity": _impurity(stats, kind), "gain": np.full(m, -1.0), "feature": np.full(m, -1), "bin": np.full(m, -1), "left": np.full(m, -1)}
        levels.append(level)
        open_ = np.flatnonzero((level["impurity"] >= 2 ** -52) & (raw >= 2 * least)) if depth < spec["depth"] and size > 1 else np.zeros(0, int)
        block = max(1, LEVEL_CELLS // (size * classes * 2))
        feats = rng.random((m, f), np.float32).argpartition(drawn - 1, axis=1)[open_, :drawn] if drawn < f else np.tile(np.arange(f), (len(open_), 1))
        # Rows of closed nodes are gone, so the rows of the open ones lie one behind the other.
        spans = np.diff(start)
        keep = np.zeros(m, bool)
        keep[open_] = True
        if not keep.all():
            rows = np.flatnonzero(np.repeat(keep, spans))
            bins, y, n, w = bins[rows], y[rows], n[rows], None if w is None else w[rows]
        if not len(open_):
            break
        edge = np.concatenate([[0], np.cumsum(spans[open_])])
        gain, feature, cut = np.full(len(open_), -np.inf), np.full(len(open_), -1), np.full(len(open_), -1)
        for s in range(0, len(open_), block):
            part = slice(s, min(s + block, len(open_)))
            at = edge[part.start:part.stop + 1]
            for j in range(feats.shape[1]):
                own = feats[part, j]
                g, b = _best(*_counts(bins, y, n, w, at, own, size, classes), per_class, least, kind)
                g = np.where(splits[own] > 0, g, -np.inf)
                better = g > gain[part]
                gain[part], feature[part], cut[part] = (np.where(better, new, old[part]) for new, old in ((g, gain), (own, feature), (b, cut)))
        split = gain > 0
        ids = open_[split]
        level["gain"][ids], level["feature"][ids], level["bin"][ids] = gain[split], feature[split], cut[split]
        level["left"][ids] = first + m + 2 * np.arange(len(ids))
        first += m
        if not len(ids):
            break
        node = np.repeat(np.arange(len(open_)), np.diff(edge))
        if not split.all():
            rows = np.flatnonzero(split[node])
            bins, y, n, w, node = bins[rows], y[rows], n[rows], None if w is None else w[rows], node[rows]
        side = bins[np.arange(len(node)), feature[node]] > cut[node]
        child = (np.cumsum(split) - 1)[node] * 2 + side
        order = np.argsort(child, kind="stable")
        bins, y, n, w, child = bins[order], y[order], n[order], None if w is None else w[order], child[order]
        key, m = child * classes + y, 2 * len(ids)
        counts = np.bincount(key, n, m * classes).reshape(m, classes)
        raw = counts.sum(1).astype(np.int64)
        stats = counts * per_class if w is None and per_class is not None else counts if w is None else np.bincount(key, n * w, m * classes).reshape(m, classes)
        start = np.concatenate([[0], np.cumsum(np.bincount(child, minlength=m))])
    tree = {c: np.concatenate([level[c] for level in levels]) for c in levels[0]}
    return _pruned(tree, np.cumsum([0] + [len(level["raw"]) for level in levels]))


def _pruned(tree, ends):
    """Leaves of one parent and one prediction are merged into it, from the deepest level up; ids are given anew."""
    best, left = tree["stats"].argmax(1), tree["left"].copy()
    for a, b in list(zip(ends[:-1], ends[1:]))[::-1]:
        inner = a + np.flatnonzero(left[a:b] >= 0)
        same = (left[left[inner]] < 0) & (left[left[inner] + 1] < 0) & (best[left[inner]] == best[left[inner] + 1])
        gone = inner[same]
        # The parent takes its children's prediction, which may differ from its own only by ties.
        best[gone] = best[left[gone]]
        left[gone] = -1
    here = np.zeros(len(left), bool)
    here[0] = True
    for a, b in zip(ends[:-1], ends[1:]):
        inner = a + np.flatnonzero(here[a:b] & (left[a:b] >= 0))
        here[left[inner]] = here[left[inner] + 1] = True
    new = np.cumsum(here) - 1
    out = {c: v[here] for c, v in tree.items()}
    out["prediction"], leaf = best[here], left[here] < 0
    out["left"] = np.where(leaf, -1, new[left[here]])
    for c, v in (("gain", -1.0), ("feature", -1), ("bin", -1)):
        out[c] = np.where(leaf, v, out[c])
    return out


def _node_rows(number, tree, points):
    """The nodes in Spark's layout, some at a time."""
    threshold = np.zeros(len(tree["left"]))
    for f, p in enumerate(points):
        own = tree["feature"] == f
        threshold[own] = p[tree["bin"][own]] if own.any() else 0
    inner = tree["left"] >= 0
    classes = tree["stats"].shape[1]
    for a in range(0, len(inner), NODES):
        s = slice(a, min(a + NODES, len(inner)))
        k = s.stop - s.start
        offsets = pa.array(np.concatenate([[0], np.cumsum(inner[s])]), pa.int32())
        split = pa.StructArray.from_arrays([pa.array(tree["feature"][s], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(threshold[s][inner[s]])),
                                            pa.array(np.full(k, -1), pa.int32())], fields=list(_SPLIT))
        stats = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * classes, pa.int32()), pa.array(tree["stats"][s].reshape(-1)))
        cells = {"id": pa.array(np.arange(s.start, s.stop), pa.int32()), "prediction": pa.array(tree["prediction"][s].astype(float)),
                 "impurity": pa.array(tree["impurity"][s]), "impurityStats": stats, "rawCount": pa.array(tree["raw"][s].astype(np.int64)),
                 "gain": pa.array(tree["gain"][s]), "leftChild": pa.array(tree["left"][s], pa.int32()),
                 "rightChild": pa.array(np.where(inner[s], tree["left"][s] + 1, -1), pa.int32()), "split": split}
        nodes = pa.StructArray.from_arrays(list(cells.values()), list(cells))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number), pa.int32()), nodes], ["treeID", "nodeData"])


def _growing(points, spec, shares):
    """Each task takes in the table and grows the trees whose number leaves its own as remainder."""
    def run(batches):
        packs = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        if not packs:
            return
        share, f = packs[0][0], len(points)
        bins = np.frombuffer(b"".join(p[1] for p in packs), np.uint8).reshape(-1, f)
        y, w, n = (np.frombuffer(b"".join(p[k] for p in packs), t) for k, t in ((2, np.int32), (3, np.float64), (4, np.int64)))
        del packs
        # Weights that the class alone decides are applied to its counts.
        low, high = np.full(spec["classes"], np.inf), np.full(spec["classes"], -np.inf)
        np.minimum.at(low, y, w)
        np.maximum.at(high, y, w)
        per_class = np.where(np.isfinite(low), low, 0.0) if (low >= high).all() else None
        for number in range(share, spec["trees"], shares):
            rng = np.random.default_rng([spec["seed"] & 0xFFFFFFFF, number])
            tree = grow_tree(bins, y, n, w if per_class is None else None, per_class, points, spec, rng)
            yield from _node_rows(number, tree, points)
    return run


# ---------------------------------------------------------------- the estimator

def _drawn(strategy, features, trees):
    """Features drawn for a node, by Spark's names; None for a strategy not met here."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    return {"all": features, "sqrt": int(np.ceil(np.sqrt(features))), "log2": max(1, int(np.ceil(np.log2(features)))),
            "onethird": int(np.ceil(features / 3))}.get(strategy)


class BinnedForestClassifier(RandomForestClassifier):
    """A ``RandomForestClassifier`` that grows its trees from counted binned rows."""

    def _fit(self, dataset):
        return self._grown(dataset) or super()._fit(dataset)

    def _grown(self, dataset):
        unmet = (self.getSubsamplingRate() != 1, self.getMinInfoGain() > 0, self.getMinWeightFractionPerNode() > 0, self.getMaxBins() > 256,
                 self.isSet("thresholds"), not self.isSet("weightCol"))
        if any(unmet):
            return None
        spark = dataset.sparkSession
        data = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("label"),
                              F.col(self.getWeightCol()).cast("double").alias("weight"))
        n, total, top, f = data.agg(F.count(F.lit(1)), F.sum("weight"), F.max("label"), F.max(F.size("x"))).first()
        if not n or not f:
            return None
        drawn = _drawn(self.getFeatureSubsetStrategy(), f, self.getNumTrees())
        if drawn is None:
            return None
        share = min(1.0, max(SPLIT_ROWS, self.getMaxBins() ** 2) / n)
        seen = (data.sample(share, self.getSeed()) if share < 1 else data).select("x", "weight").toPandas()
        x, w = np.stack(seen["x"]) if len(seen) else np.zeros((0, f)), seen["weight"].to_numpy(float)
        points = [np.unique(split_points(x[:, k], w, share * total, self.getMaxBins() - 1)) for k in range(f)]
        rows = data.mapInArrow(_binned(points), "bins binary, label int, weight double")
        table = materialize(rows.groupBy("bins", "label", "weight").agg(F.count(F.lit(1)).alias("n")), "binned")
        if table.count() > TABLE_ROWS:
            return None
        classes = top + 1
        spec = {"classes": classes, "drawn": drawn, "least": self.getMinInstancesPerNode(), "impurity": self.getImpurity(), "depth": self.getMaxDepth(),
                "bootstrap": self.getBootstrap(), "trees": self.getNumTrees(), "seed": self.getSeed()}
        shares = max(1, min(spec["trees"], spark.sparkContext.defaultParallelism))
        ordered = table.sortWithinPartitions("bins", "label", "weight")
        packs = ordered.mapInArrow(_packed, "bins binary, label binary, weight binary, n binary")
        dealt = packs.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "*").repartitionById(shares, F.col("share"))
        path = scratch_path(spark, "forest")
        dealt.mapInArrow(_growing(points, spec, shares), _NODE).write.parquet(f"{path}/data")
        self._describe(spark, path, f, classes)
        return RandomForestClassificationModel.load(path)

    def _describe(self, spark, path, features, classes):
        """What stands beside the nodes in Spark's layout: the forest's settings and those of its trees."""
        given, usual = ({p.name: v for p, v in m.items()} for m in (self._paramMap, self._defaultParamMap))
        base = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        of_tree = [c for c in given if c not in ("numTrees", "bootstrap", "featureSubsetStrategy", "subsamplingRate")]
        kind = "org.apache.spark.ml.classification."
        trees = [(k, json.dumps(base | {"class": kind + "DecisionTreeClassificationModel", "uid": f"dtc_{self.uid}_{k}", "paramMap": {c: given[c] for c in of_tree},
                                        "defaultParamMap": {}, "numFeatures": features, "numClasses": classes}), 1.0) for k in range(self.getNumTrees())]
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        whole = base | {"class": kind + "RandomForestClassificationModel", "uid": self.uid, "paramMap": given, "defaultParamMap": usual,
                        "numFeatures": features, "numClasses": classes, "numTrees": self.getNumTrees()}
        spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
