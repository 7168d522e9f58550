"""Detectors: Spark ML classifiers, and isolation forest and local outlier factor as distributed jobs."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, NaiveBayes
from pyspark.ml.feature import PCA, Bucketizer, ElementwiseProduct, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window
from pyspark.sql import functions as F

from hosttrace.operators.forest import SPLIT_ROWS, BinnedForestClassifier, split_points
from hosttrace.operators.ordered import row_numbers
from hosttrace.session import materialize, scratch_dir

SEED = 0
NEIGHBOURS = 20


def with_balanced_weight(df, label="label", weight="weight"):
    """Class weight n / (classes * n_class). One row per class reaches the driver."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    out = F
    for value, n in counts.items():
        out = out.when(F.col(label) == value, total / (len(counts) * n))
    return df.withColumn(weight, out)


MAX_DEPTH = 30  # as deep as Spark's trees go
MAX_BINS = 32   # candidate split points of a feature; more follow the data closer and cost more per node
# How deep trees are grown, not what they are: executors keep each row's node, so the trees so far are not sent to every
# task of every level, and a pass over the rows serves more nodes.
GROWTH = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 512}


def _forest(trees, leaf, bins=MAX_BINS, **extra):
    return BinnedForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees,
                                  minInstancesPerNode=leaf, maxBins=bins, seed=SEED, **GROWTH, **extra)


def supervised(bins=MAX_BINS):
    """The compared classifiers with their published settings. Spark trees stop at depth 30."""
    return {
        "Naive Bayes": NaiveBayes(modelType="gaussian", labelCol="label"),
        "Decision Tree": _forest(1, 5, bins, bootstrap=False, impurity="entropy", maxDepth=17,
                                 featureSubsetStrategy="log2"),
        "Random Forest": _forest(70, 9, bins, bootstrap=False, maxDepth=MAX_DEPTH, featureSubsetStrategy="sqrt"),
        "Linear SVM": LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", maxIter=50),
    }


def small_forest(trees=20, depth=10):
    """A light forest for loops that only need a ranking of features."""
    return _forest(trees, 1, maxDepth=depth)


def preparation(columns, scale=True, components=0):
    """Vector assembly, optional standard scaling, optional principal components."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="assembled", handleInvalid="keep")]
    last = "assembled"
    if scale:
        stages.append(StandardScaler(withMean=True, inputCol=last, outputCol="scaled"))
        last = "scaled"
    if components:
        stages.append(PCA(k=components, inputCol=last, outputCol="components"))
        last = "components"
    stages[-1].setOutputCol("features")
    return stages


def _checkpointed(spark):
    """Cached node ids are cut off from their lineage only where the context has a checkpoint folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))


FIT_ROWS = 250_000  # rows of a fit's task; a task is sent on with the counts of all nodes in work, so few large ones


def merge_equal(rows, least, weight="weight"):
    """Equal rows as fewer copies of them that share their weight, for forests that use every row in every tree.

    Such a forest meets rows in sums of weights and in the least number of rows of a leaf. Of ``n`` equal rows ``least``
    stay, or all there are, so the same leaves are large enough; more stay until no copy stands for more rows than a
    distinct row does on average, so the sample from which Spark takes its candidate split points is not led by a few.
    """
    spark = rows.sparkSession
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")), "distinct")
    n, distinct = counted.agg(F.sum("_n"), F.count(F.lit(1))).first()
    if not distinct:
        return rows
    copies = F.greatest(F.least("_n", F.lit(least)), F.ceil(F.col("_n") * F.lit(distinct / n)))
    shared = counted.withColumn("_copies", F.least("_n", copies).cast("int")).withColumn(
        weight, F.col(weight) * F.col("_n") / F.col("_copies"))
    dealt = shared.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*rows.columns)
    return materialize(dealt.repartition(max(spark.sparkContext.defaultParallelism, -(-distinct // FIT_ROWS))), "merged")


def uses_every_row(classifier):
    return classifier.hasParam("bootstrap") and not classifier.getBootstrap() and classifier.getSubsamplingRate() == 1


def fit_merged(train, columns, forest):
    """As ``fit_classifier`` without scaling, for forests that use every row in every tree and rows that are often equal.

    Split points come from a sample of all rows, as in Spark's trees; rows between the same points are equal to every
    tree and are merged. The trees see the numbers of the bins and may split between any two of them.
    """
    _checkpointed(train.sparkSession)
    data = with_balanced_weight(train.select(*columns, "label").withColumn("label", F.col("label").cast("double")))
    n = data.count()
    share = min(1.0, SPLIT_ROWS / max(n, 1))
    drawn = (data.sample(share, SEED) if share < 1 else data).select(*columns, "weight").toPandas().astype(float)
    points = [np.unique(split_points(drawn[c].to_numpy(), drawn["weight"].to_numpy(), share * n, forest.getMaxBins() - 1)) for c in columns]
    # A tree sends a value equal to its point to the left, a bucket starts with its own edge.
    edges = [[-np.inf, *(np.nextafter(p, np.inf) if len(p) else [np.finfo(float).max]), np.inf] for p in points]
    bins = [f"{c}_bin" for c in columns]
    cut = Bucketizer(splitsArray=[[float(x) for x in e] for e in edges], inputCols=list(columns), outputCols=bins, handleInvalid="keep")
    vector = VectorAssembler(inputCols=bins, outputCol="bins", handleInvalid="keep")
    # Buckets are marked as categories; times one they are the plain numbers again, and stay in order.
    plain = ElementwiseProduct(scalingVec=Vectors.dense([1.0] * len(bins)), inputCol="bins", outputCol="features")
    rows = merge_equal(cut.transform(data).select(*bins, "label", "weight"), forest.getMinInstancesPerNode())
    return PipelineModel([cut, vector, plain, forest.copy().fit(plain.transform(vector.transform(rows)))])


def fit_classifier(train, columns, classifier, scale=True, components=0):
    """A PipelineModel from feature columns to prediction. Scaler and components see training rows only."""
    _checkpointed(train.sparkSession)
    data = with_balanced_weight(train.select(*columns, "label").withColumn("label", F.col("label").cast("double")))
    return Pipeline(stages=[*preparation(columns, scale, components), classifier.copy()]).fit(data)


def score_classifier(model, df):
    """Add ``score`` (probability, or margin for the SVM) and ``pred``; assembly columns are dropped."""
    out = model.transform(df)
    source = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select(*df.columns, vector_to_array(F.col(source))[1].alias("score"),
                      F.col("prediction").cast("int").alias("pred"))


def fit_typer(attacks, columns, target="scenario", trees=200):
    """Attack-type classifier on positive processes, with the type name and its confidence on transform."""
    _checkpointed(attacks.sparkSession)
    weighted = with_balanced_weight(attacks, target)
    indexer = StringIndexer(inputCol=target, outputCol="type_index", handleInvalid="skip").fit(weighted)
    forest = BinnedForestClassifier(featuresCol="features", labelCol="type_index", weightCol="weight",
                                    numTrees=trees, minInstancesPerNode=3, maxDepth=MAX_DEPTH, seed=SEED, **GROWTH)
    names = IndexToString(inputCol="prediction", outputCol="attack_type", labels=indexer.labels)
    stages = [*preparation(columns, scale=False), forest]
    fitted = Pipeline(stages=stages).fit(indexer.transform(weighted))
    fitted.stages.append(names)
    return fitted


def type_of(typer, df):
    out = typer.transform(df)
    return out.select(*df.columns, "attack_type",
                      F.array_max(vector_to_array(F.col("probability"))).alias("type_confidence"))


def impurity_importance(model, columns):
    forest = model.stages[-1]
    return sorted(zip(columns, forest.featureImportances.toArray().tolist()), key=lambda p: -p[1])


def permuted_copies(df, columns, keys, repeats, seed=SEED):
    """The columns of ``df``, repeat, feature and moved: each row once for each column and repeat, with that column from another row.

    ``moved`` tells whether the other row has another value there.

    In a repeat equal ranks in the order of ``keys`` and in a salted order of them meet, which is a permutation of the
    rows. Both orders are range-partitioned. The copies are a narrow fan-out for the scoring that follows. Rows without
    a key take no part.
    """
    salt = F.md5(F.concat_ws("|", F.col("repeat").cast("string"), F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    plain = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    rows = materialize(row_numbers(plain, [], list(keys), "_rn"), "permute")
    each = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    other = row_numbers(each.select("repeat", salt.alias("_salt"), "_rn", F.struct(*columns).alias("_other")).withColumnRenamed("_rn", "_tie"),
                        ["repeat"], ["_salt", "_tie"], "_rn").select("repeat", "_rn", "_other")
    met = each.join(other, ["repeat", "_rn"]).drop("_rn")
    spread = met.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
    moved = F.coalesce(*[F.when(F.col("feature") == c, ~F.col(c).eqNullSafe(F.col("_other")[c])) for c in columns])
    put = {c: F.when(F.col("feature") == c, F.col("_other")[c]).otherwise(F.col(c)) for c in columns}
    return spread.withColumn("moved", moved).withColumns(put).drop("_other")


# --- isolation forest ---------------------------------------------------------------------------------------------

SAMPLE = 256
_TREE = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, size array<int>"


def _grow(columns, seed):
    depth_limit = int(np.ceil(np.log2(SAMPLE)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100_003 + tree)
        feature, cut, left, right, size = [], [], [], [], []

        def node(x, depth):
            i = len(feature)
            for part, value in zip((feature, cut, left, right, size), (-1, 0.0, -1, -1, len(x))):
                part.append(value)
            varied = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
            if depth < depth_limit and len(varied):
                f = int(rng.choice(varied))
                c = float(rng.uniform(x[:, f].min(), x[:, f].max()))
                below = x[:, f] <= c
                feature[i], cut[i] = f, c
                left[i], right[i] = node(x[below], depth + 1), node(x[~below], depth + 1)
            return i

        node(pdf.sort_values("_r")[list(columns)].to_numpy(float), 0)
        return pd.DataFrame([{"tree": tree, "feature": feature, "cut": cut, "left": left, "right": right,
                              "size": size}])
    return grow


def _expected_depth(n):
    n = np.asarray(n, float)
    deep = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def fit_isolation_forest(benign, columns, trees=200, seed=SEED):
    """One task per tree over its own 256-row random sample; the forest is at most trees x 511 nodes.

    Rows draw a random key; the ``trees * 256`` smallest keys, a top-N without a full sort, are dealt to the trees. Where
    rows are fewer, trees share them: each row goes to each tree at the rate that gives a tree its 256, or all rows.
    """
    n = trees * SAMPLE
    drawn = materialize(benign.select(*columns).withColumn("_r", F.rand(seed)).orderBy("_r").limit(n), "drawn")
    have = drawn.count()
    if have == n:
        dealt = drawn.withColumn("tree", F.pmod(F.xxhash64("_r"), F.lit(trees)).cast("int"))
    else:
        rate = int(min(1.0, SAMPLE / max(have, 1)) * 1_000_000)
        joins = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("_r", t), F.lit(1_000_000)) < rate)
        dealt = drawn.withColumn("tree", F.explode(joins))
    grown = dealt.groupBy("tree").applyInPandas(_grow(columns, seed), _TREE)
    return {"columns": list(columns), "trees": grown.toPandas().to_dict("records")}


def score_isolation_forest(forest, df):
    """Anomaly score in (0, 1): 2 ** (-mean depth / expected depth). The forest travels as one broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(
        [{k: np.asarray(t[k]) for k in ("feature", "cut", "left", "right", "size")} for t in forest["trees"]])
    columns = forest["columns"]

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        trees = shared.value
        base = float(_expected_depth(np.mean([t["size"][0] for t in trees])))
        for pdf in parts:
            x, total = pdf.to_numpy(float), np.zeros(len(pdf))
            for t in trees:
                at, depth = np.zeros(len(x), int), np.zeros(len(x))
                inner = t["feature"][at] >= 0
                while inner.any():
                    rows = np.flatnonzero(inner)
                    node = at[rows]
                    down = x[rows, t["feature"][node]] <= t["cut"][node]
                    at[rows] = np.where(down, t["left"][node], t["right"][node])
                    depth[rows] += 1
                    inner = t["feature"][at] >= 0
                total += depth + _expected_depth(t["size"][at])
            yield pd.Series(np.power(2.0, -total / len(trees) / base))

    return df.withColumn("score", score(F.struct(*columns)))


# --- nearest neighbours and local outlier factor ------------------------------------------------------------------

def _vectors(df, columns):
    return F.array(*[F.col(c).cast("double") for c in columns]) if not isinstance(columns, str) else F.transform(
        F.col(columns), lambda v: v.cast("double"))


def _pivots(points, cells, seed):
    rows = points.select("v").orderBy(F.xxhash64("v", F.lit(seed))).limit(cells).collect()
    return np.array([r[0] for r in rows], float)


def _distances(a, b):
    """Distances of all rows of ``a`` to all of ``b``, worked out in the one matrix that is returned."""
    sq = a @ b.T
    sq *= -2
    sq += (a * a).sum(1)[:, None]
    sq += (b * b).sum(1)[None, :]
    return np.sqrt(np.maximum(sq, 0.0, out=sq), out=sq)


def _matrix(vectors):
    """A column of vectors as rows of numbers, without a Python object for each number."""
    return np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.zeros((0, 0))


PART = 2_000  # rows whose distances to the pivots are worked out at once


def _exact(a, b):
    return np.sqrt(((a - b) ** 2).sum(-1))


def _assign(shared):
    @F.pandas_udf("struct<cell int, d double>")
    def assign(v: pd.Series) -> pd.DataFrame:
        cells, own = [], []
        for at in range(0, len(v), PART):
            d = _distances(_matrix(v.iloc[at:at + PART]), shared.value)
            cells.append(d.argmin(1).astype("int32"))
            own.append(d[np.arange(len(d)), cells[-1]])
        return pd.DataFrame({"cell": np.concatenate(cells), "d": np.concatenate(own)} if cells else {"cell": [], "d": []})
    return assign


BLOCK_CELLS = 1_000_000  # distances between queries and points at hand at once: 8 MB


def _block_top(k):
    """k nearest points of one (cell, block) for the queries sent to it; queries come in bounded batches."""
    def top(key, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "pid": [], "d": [], "weight": []}
        if len(queries) and len(points):
            p = _matrix(points["v"])
            names, weight = points["pid"].to_numpy(), points["weight"].to_numpy()
            keep = min(k + 8, len(p))  # a few spare, so rounding in the fast distances cannot drop a neighbour
            step = max(1, min(256, BLOCK_CELLS // len(p)))
            for at in range(0, len(queries), step):
                part = queries.iloc[at:at + step]
                q = _matrix(part["v"])
                near = np.argpartition(_distances(q, p), keep - 1, axis=1)[:, :keep].copy()
                out["d"].append(_exact(p[near], q[:, None, :]).ravel())
                out["qid"].append(np.repeat(part["qid"].to_numpy(), keep))
                out["pid"].append(names[near].ravel())
                out["weight"].append(weight[near].ravel())
        return pd.DataFrame({c: np.concatenate(v) if v else np.array([], "float64" if c == "d" else "int64")
                             for c, v in out.items()})
    return top


_NEAR = "qid long, pid long, d double, weight long"


def nearest_points(queries, points, k, cells=None, block_rows=20_000, seed=SEED, same_points=False):
    """Exact k nearest points per query as rows (qid, pid, d, weight), closest first by (d, pid).

    Points are distinct vectors ``(pid, v, weight)``, weight counting their copies, so any number of copies of one
    vector is a single row. Each point belongs to the cell of its nearest pivot. A query searches its own cell first;
    its k-th distance r then bounds the search, and by the triangle inequality only cells whose pivot is nearer than
    ``(distance to own pivot) + 2 r`` can hold something closer. Cells split into blocks of bounded size, so a crowded
    cell is many tasks. With ``same_points`` a query's own vector counts one copy less.
    """
    spark = points.sparkSession
    cells = cells or min(1024, max(16, points.count() // block_rows))
    pivots = _pivots(points, cells, seed)
    shared = spark.sparkContext.broadcast(pivots)
    assign = _assign(shared)
    placed = points.withColumn("_a", assign("v")).select("pid", "v", "weight", F.col("_a.cell").alias("cell"))
    sizes = {r["cell"]: -(-r["n"] // block_rows) for r in
             placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.try_element_at(F.create_map(*[F.lit(int(x)) for kv in sizes.items() for x in kv]), F.col("cell"))
    placed = materialize(placed.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")).drop("blocks"), "cells")
    asked = materialize(queries.withColumn("_a", assign("v")).select(
        "qid", "v", F.col("_a.cell").alias("cell"), F.col("_a.d").alias("own")), "queries")

    def search(q):
        spread = q.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        # A crowded block receives many queries: they split into bounded shares that each see the block.
        shares = q.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("shares"))
        spread = spread.join(F.broadcast(shares), "cell").withColumn(
            "share", F.pmod(F.xxhash64("qid"), F.col("shares")).cast("int"))
        copies = placed.join(F.broadcast(shares), "cell").withColumn(
            "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        keys = ["cell", "block", "share"]
        found = spread.select(*keys, "qid", "v").groupBy(*keys).cogroup(
            copies.select(*keys, "pid", "v", "weight").groupBy(*keys)).applyInPandas(_block_top(k), _NEAR)
        return found

    def best(found):
        """Closest rows until the copies add up to k."""
        if same_points:
            found = found.withColumn("weight", F.when(F.col("qid") == F.col("pid"), F.col("weight") - 1)
                                     .otherwise(F.col("weight"))).where("weight > 0")
        w = Window.partitionBy("qid").orderBy("d", "pid")
        before = F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return found.withColumn("_before", before).where(F.col("_before") < k).withColumn(
            "weight", F.least(F.col("weight"), F.lit(k) - F.col("_before"))).drop("_before")

    first = materialize(search(asked), "near")
    bound = best(first).groupBy("qid").agg(F.max("d").alias("r"), F.sum("weight").alias("have"))

    @F.pandas_udf("array<int>")
    def reachable(v: pd.Series, own_cell: pd.Series, own: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(v), PART):
            part = slice(at, at + PART)
            near = _distances(_matrix(v.iloc[part]), shared.value)
            near = near <= own.to_numpy()[part, None] + 2 * r.to_numpy()[part, None] * (1 + 1e-9) + 1e-9
            near[np.arange(len(near)), own_cell.to_numpy()[part]] = False
            out += [np.flatnonzero(row).astype("int32") for row in near]
        return pd.Series(out)

    limited = asked.join(bound, "qid", "left").withColumn(
        "r", F.when(F.coalesce("have", F.lit(0)) >= k, F.col("r")).otherwise(F.lit(float("inf"))))
    more = limited.withColumn("cell", F.explode(reachable("v", "cell", "own", "r"))).select("qid", "v", "cell").where(
        F.col("cell").isin(*sizes))
    return best(first.unionByName(search(more)))


def distinct_vectors(df, columns):
    """(pid, v, weight): one row per distinct vector with its number of copies."""
    counted = df.select(_vectors(df, columns).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("weight"))
    return materialize(counted.withColumn("pid", F.xxhash64("v")), "vectors")


def fit_lof(train, columns, k=NEIGHBOURS):
    """Local reachability density of every distinct training vector, as tables."""
    points = distinct_vectors(train, columns)
    near = nearest_points(points.select(F.col("pid").alias("qid"), "v"), points, k, same_points=True)
    near = materialize(near, "neighbours")
    k_distance = materialize(near.groupBy("qid").agg(F.max("d").alias("kd")), "kdist")
    density = materialize(_density(near, k_distance), "density")
    return {"columns": columns, "k": k, "points": points, "kdist": k_distance, "density": density}


def _density(near, k_distance):
    reach = near.join(k_distance.select(F.col("qid").alias("pid"), "kd"), "pid").withColumn(
        "reach", F.greatest("d", "kd"))
    return reach.groupBy("qid").agg(
        (1.0 / (F.sum(F.col("reach") * F.col("weight")) / F.sum("weight") + 1e-10)).alias("lrd"))


def score_lof(model, df):
    """Outlier factor of new rows against the training set (novelty scoring): higher is more anomalous."""
    v = _vectors(df, model["columns"])
    rows = df.withColumn("qid", F.xxhash64(v))
    asked = rows.select("qid", v.alias("v")).groupBy("qid").agg(F.any_value("v").alias("v"))
    near = materialize(nearest_points(asked, model["points"], model["k"]), "neighbours")
    own = _density(near, model["kdist"])
    around = near.join(model["density"].select(F.col("qid").alias("pid"), "lrd"), "pid").groupBy("qid").agg(
        (F.sum(F.col("lrd") * F.col("weight")) / F.sum("weight")).alias("around"))
    factor = own.join(around, "qid").select("qid", (F.col("around") / F.col("lrd")).alias("score"))
    return rows.join(factor, "qid", "left").drop("qid")
