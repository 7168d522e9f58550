"""Lloyd clustering of integer vectors with Orchard's search for the nearest centroid.

Every centroid keeps all others in a list sorted by their distance to it. A search starts from the centroid in the middle
and walks its list; whenever a centroid is nearer (or as near and of a smaller number) it becomes the current one and the
walk goes on in its list. Centroids already looked at are marked. A walk ends at the first entry strictly farther from
the current centroid than twice the current distance: nothing beyond can be as near, and an entry at exactly twice the
distance may tie. All numbers are integers, so ties are exact and results do not depend on how rows are partitioned.

Tasks walk all vectors of a batch in step and send one sum for each centroid; only those meet in a shuffle, and the driver
sees centroids alone. Kept vectors are written once and read every round.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left out; with fewer
vectors than centroids every one is a centroid, an empty table gives an empty result; a null vec_id counts as empty text
in the start order and stays in the result; repeated rows are separate vectors, and among equal vec_ids the start order
follows the components; other columns are not read. Components beyond ``LIMIT`` raise an error, since the sums of squares
that the result is made of would not fit a long.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hosttrace.llm.common import materialize

DIMS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
LIMIT = 1 << 27  # differences of two stay below 2^28, sums of 64 squares below 2^62


def matrix(column, dims):
    """(rows kept, their components): the vectors of ``dims`` finite components in an Arrow list column."""
    column = column.cast(pa.list_(pa.float64()))
    offsets, flat = column.offsets.to_numpy(), column.values
    sizes = np.where(np.asarray(column.is_valid()), np.diff(offsets), -1)
    rows = np.flatnonzero(sizes == dims)
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[rows][:, None] + np.arange(dims)]
    keep = np.isfinite(x).all(axis=1)  # a null component arrives as NaN
    return rows[keep], x[keep]


def integer_vectors(vectors, vec_id="vec_id", embedding="embedding", dims=DIMS, scale=SCALE):
    """(vec_id, v) of the kept vectors; v holds floor(scale * x) of each component."""
    kind = vectors.schema[vec_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, x = matrix(batch.column(1), dims)
            v = np.floor(x * scale)
            if np.abs(v).max(initial=0) > LIMIT:
                raise ValueError(f"a component times {scale} exceeds {LIMIT}")
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dims), pa.array(v.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), values], ["vec_id", "v"])

    return vectors.select(F.col(vec_id), F.col(embedding)).mapInArrow(run, f"vec_id {kind}, v array<int>")


class Neighbours:
    """Each centroid's list of the others, nearest first, and where a walk along it may stop."""

    def __init__(self, centroids):
        self.c = np.array(centroids, np.int64)
        apart = ((self.c[:, None] - self.c[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, -1)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        # apart > 4 * d for whole numbers is (apart - 1) // 4 >= d, which cannot overflow.
        self.stop = (np.take_along_axis(apart, self.order, axis=1) - 1) // 4
        self.first = int(apart.sum(axis=1, dtype=np.float64).argmin())

    def nearest(self, x):
        """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number."""
        n, k = len(x), len(self.c)
        best = np.full(n, self.first)
        d = ((x - self.c[self.first]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), bool)
        seen[:, self.first] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n)
        while len(walking):
            walking = walking[place[walking] < k - 1]
            walking = walking[self.stop[best[walking], place[walking]] < d[walking]]
            c = self.order[best[walking], place[walking]]
            fresh = ~seen[walking, c]
            place[walking] += 1
            w, c = walking[fresh], c[fresh]
            seen[w, c] = True
            e = ((x[w] - self.c[c]) ** 2).sum(axis=1)
            nearer = (e < d[w]) | (e == d[w]) & (c < best[w])
            w = w[nearer]
            best[w], d[w], place[w] = c[nearer], e[nearer], 0
        return best, d


def _rows(batch):
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def sums(kept, centroids):
    """{number: (count, component sums)} of the vectors nearest to each centroid."""
    near = Neighbours(centroids)
    k, dims = near.c.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch)
                best, _ = near.nearest(x)
                count += np.bincount(best, minlength=k)
                np.add.at(total, best, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                         ["cluster", "n", "s"])

    parts = kept.mapInArrow(run, "cluster int, n long, s array<long>")
    rows = parts.select("cluster", "n", F.posexplode("s").alias("p", "s")).groupBy("cluster", "p").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = {}
    for r in rows:
        out.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["p"]] = int(r["s"])
    return out


def first_centroids(kept, centroids=CENTROIDS, seed=SEED):
    """The vectors whose ids have the smallest hashes, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in kept.select(key.alias("h"), "v").orderBy("h", "v").limit(centroids).collect()]


def fit(kept, centroids=CENTROIDS, rounds=ROUNDS, seed=SEED):
    """Centroids after ``rounds`` rounds of exact floor means; a centroid without vectors stays."""
    found = first_centroids(kept, centroids, seed)
    for _ in range(rounds if found else 0):
        for number, (n, total) in sums(kept, found).items():
            found[number] = [s // n for s in total]
    return found


def assign(kept, centroids):
    """(vec_id, cluster, distance) of each kept vector."""
    near = Neighbours(centroids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                best, d = near.nearest(_rows(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors, centroids=CENTROIDS, rounds=ROUNDS, seed=SEED, vec_id="vec_id", embedding="embedding", dims=DIMS, scale=SCALE):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    kept = materialize(integer_vectors(vectors, vec_id, embedding, dims, scale), "integer-vectors")
    found = fit(kept, centroids, rounds, seed)
    if not found:
        found = [[0] * dims]  # no vector will meet it
    assigned = materialize(assign(kept, found), "clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [(n, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, found[n])).encode()).hexdigest()) for n, d in inertia.items()]
    per_cluster = vectors.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # As many rows as there are centroids, a parameter.
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
