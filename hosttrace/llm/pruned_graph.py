"""Embedding near-duplicates by a robust-pruned flat graph.

Only vectors of one part (equal label, equal length) are compared. Equal directions are one class with a weight, so exact
copies cost nothing. A part of more than ``REGION`` classes is split by sampled centres, again and again: a class is a member
of the region of its nearest centre alone, and as a query it visits every region whose border it is near. A border is the
plane halfway between two centres, and a vector within distance r of one in another region lies within r of that border,
so visiting up to a full r is exact and a fraction of it, ``margin``, finds nearly all. What centres cannot tell apart is split by
number, and queries visit all its blocks. Every pair is met in the region of its second member and in no other, so links
are counted in place, and no pair is ever a row: each task sends a count for each query and a star forest of its links.

Inside a region members go to the two nearest of several centres. Each of these overlapping shards gets its graph: candidates are
the nearest members and some far ones, and a candidate is pruned if one kept before is nearer to it by ``ALPHA``; a member's
lists from its shards are united in Spark. A query starts at the shards' medoids and follows its best ``beam`` members
greedily; then the range expands through every member within ``SLACK`` radii until nothing new is within. Cosines are of
double precision, and only pairs at the threshold or above count.

The links of up to ``AUDIT`` classes are counted again against all rows. If the graph found less than ``TARGET`` of them, the
search is repeated with more effort; the last effort visits a full r and compares its region whole, which is exact.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing, nor does one
whose label is null; vectors of different lengths do not link; repeated rows, also of one vec_id, are separate vectors and
link; a null vec_id stays in the result, and a component's id is its smallest vec_id that is not null (null if there is
none; then nothing of it is kept); an empty table gives an empty result; other columns are not read.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from hosttrace.llm.common import materialize
from hosttrace.llm.covering_lsh import components

SIMILARITY = 0.98
REGION = 4096
SHARD = 512
OVERLAP = 2
DEGREE = 24
NEAREST = 64
FAR = 16
ANSWERED = 6  # of a member's edges, those that always get an edge back
ALPHA = 1.2
SLACK = 1.5
QUERIES = 2048   # of one task; its region is repeated for every so many
CHUNK = 256
PAIRS = 1 << 17  # looked at together
AUDIT = 256
TARGET = 0.99
BROADCAST = 2048  # centre sets, of at most 128 vectors each


# ---------------------------------------------------------------- classes

def unit_rows(column):
    """The unit vector of each row of an Arrow list column as bytes of doubles; None where there is none."""
    out = []
    column = column.cast(pa.list_(pa.float64()))
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)  # a null component arrives as NaN
    for ok, a, b in zip(column.is_valid().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        x = flat[a:b] if ok else flat[:0]
        top = np.abs(x).max(initial=0)
        if not 0 < top < np.inf:
            out.append(None)
            continue
        x = x / top  # neither squares nor their sum leave the range of doubles
        out.append((x / np.sqrt(x @ x) + 0.0).tobytes())
    return out


def units(vectors, vec_id="vec_id", embedding="embedding", label="label"):
    """(vec_id, part, u) for each row; u is null for what links with nothing."""
    kind = vectors.schema[vec_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            u = [None if p is None else v for p, v in zip(batch.column(1).to_pylist(), unit_rows(batch.column(2)))]
            part = [None if v is None else f"{len(v) // 8}:{p}" for p, v in zip(batch.column(1).to_pylist(), u)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.string()), pa.array(u, pa.binary())], ["vec_id", "part", "u"])

    return vectors.select(F.col(vec_id), F.col(label).cast("string").alias("l"), F.col(embedding)).mapInArrow(run, f"vec_id {kind}, part string, u binary")


def _matrix(values):
    values = list(values)
    return np.frombuffer(b"".join(values)).reshape(len(values), -1) if values else np.zeros((0, 1))


# ---------------------------------------------------------------- regions

def centre_sets(rows, sizes, per):
    """(region, c): some members of each region in ``sizes`` (region, n), about one for every ``per``, 4 to 64, by hash."""
    h = F.xxhash64("node", "region")
    wanted = F.least(F.lit(64), F.greatest(F.lit(4), F.ceil(F.col("n") / per)))
    drawn = F.when(F.pmod(h, F.lit(1 << 30)) * F.col("n") < wanted * (1 << 30), F.col("u"))
    found = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST * 64 else sizes, "region").groupBy("region").agg(
        F.sort_array(F.collect_set(drawn)).alias("c"), F.min_by("u", h).alias("one"))
    return found.select("region", F.when(F.size("c") > 0, F.col("c")).otherwise(F.array("one")).alias("c"))


def near_centres(rows, centres, top=None, margin=None):
    """``rows`` with ``child``, the numbers of centres each goes to: the ``top`` nearest, or all whose border is within ``margin``."""
    columns = rows.columns
    joined = rows.join(F.broadcast(centres) if centres.count() <= BROADCAST else centres, "region")
    at, kinds = columns.index("u"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            child = [None] * batch.num_rows
            region = np.array(batch.column(len(columns)).to_pylist())
            u = batch.column(at).to_pylist()
            for name in np.unique(region):
                here = np.flatnonzero(region == name)
                c = _matrix(batch.column(len(columns) + 1)[int(here[0])].as_py())
                x = _matrix([u[i] for i in here.tolist()])
                dots = x @ c.T
                if top is not None:
                    picks = np.argsort(-dots, axis=1, kind="stable")[:, :top].tolist()
                else:
                    own = dots.argmax(axis=1)
                    apart = np.sqrt(np.maximum(0, ((c[:, None] - c[None]) ** 2).sum(axis=2)))
                    # 1e-9: rounding must not hide a centre at the margin itself.
                    near = dots[np.arange(len(x)), own][:, None] - dots <= margin * apart[own] + 1e-9
                    picks = [np.flatnonzero(r).tolist() for r in near]
                for i, p in zip(here.tolist(), picks):
                    child[i] = p
            yield pa.RecordBatch.from_arrays(batch.columns[:len(columns)] + [pa.array(child, pa.list_(pa.int32()))], columns + ["child"])

    return joined.select(*columns, F.col("region").alias("_r"), "c").mapInArrow(run, f"{kinds}, child array<int>")


def regions(classes, margin):
    """(members, queries), both with ``region``: members are in one region each, queries in all they visit."""
    members = classes.select(F.col("part").alias("region"), "node", "w", "u")
    queries = members.drop("w")
    done, asked, stuck = [], [], {}
    while True:
        sizes = materialize(members.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region-sizes")
        big = sizes.where(F.col("n") > REGION)
        if not big.limit(1).count():
            break
        # As many rows as regions above the limit; sides are broadcast behind a count.
        keys = F.broadcast(big) if big.count() <= BROADCAST * 64 else big
        done.append(members.join(keys, "region", "left_anti"))
        asked.append(queries.join(keys, "region", "left_anti"))
        members, queries = members.join(keys.select("region"), "region", "left_semi"), queries.join(keys.select("region"), "region", "left_semi")
        blocks = big.where(F.col("region").endswith("/?"))
        split = big.where(~F.col("region").endswith("/?"))
        centres = materialize(centre_sets(members, split, REGION / 4), "centres")
        name = F.concat("region", F.lit("/"), F.col("k").cast("string"))

        def by_centre(rows, **how):
            return near_centres(rows, centres, **how).withColumn("k", F.explode("child")).drop("child").withColumn("region", name).drop("k")

        def by_number(rows, k):
            dealt = rows.join(blocks.select("region", F.ceil(F.col("n") / (REGION // 2)).cast("int").alias("g")), "region").withColumn("k", k)
            return dealt.withColumn("region", name).drop("k", "g")

        fresh = by_centre(members, top=1).unionByName(by_number(members, F.pmod(F.xxhash64("node"), F.col("g"))))
        fresh = materialize(fresh, "members")
        # A child with nearly all its parent had is split by number next time.
        now = fresh.groupBy("region").agg(F.count(F.lit(1)).alias("m")).withColumn("parent", F.regexp_replace("region", "/[^/]*$", ""))
        same = now.join(big.select(F.col("region").alias("parent"), "n"), "parent").where((F.col("m") > REGION) & (F.col("m") > 0.9 * F.col("n"))).select("region")
        same = materialize(same, "same")

        def marked(rows):
            flag = same.select("region", F.lit("/?").alias("mark"))
            return rows.join(F.broadcast(flag) if same.count() <= BROADCAST * 64 else flag, "region", "left").withColumn(
                "region", F.concat("region", F.coalesce("mark", F.lit("")))).drop("mark")

        visits = by_centre(queries, margin=margin).unionByName(by_number(queries, F.explode(F.sequence(F.lit(0), F.col("g") - 1))))
        members, queries = materialize(marked(fresh), "members"), materialize(marked(visits), "queries")
    for m, q in zip(done, asked):
        members, queries = members.unionByName(m), queries.unionByName(q)
    return materialize(members, "members"), materialize(queries, "queries")


# ---------------------------------------------------------------- graph

def pruned(x):
    """Robust-pruned neighbour lists of the rows of ``x``, with edges back, as a list of index arrays."""
    m = len(x)
    if m == 1:
        return [np.zeros(0, np.int64)]
    c = min(NEAREST, m - 1)
    far = np.unique(np.linspace(0, m - 1, min(FAR, m)).astype(np.int64))
    out, a, b, dist, late = [], [], [], [], []
    for s in range(0, m, CHUNK):
        here = np.arange(s, min(m, s + CHUNK))
        dots = x[here] @ x.T
        dots[np.arange(len(here)), here] = -np.inf
        near = np.argpartition(-dots, c - 1, axis=1)[:, :c]
        pool = np.concatenate([near, np.broadcast_to(far, (len(here), len(far)))], axis=1)
        d = 2 - 2 * np.take_along_axis(dots, pool, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        pool, d = np.take_along_axis(pool, order, axis=1), np.take_along_axis(d, order, axis=1)
        open_, kept = np.isfinite(d), [[] for _ in here]
        vectors = x[pool]
        rows = np.arange(len(here))
        for k in range(DEGREE):
            rows = rows[open_[rows].any(axis=1)]
            if not len(rows):
                break
            first = open_[rows].argmax(axis=1)
            for r, f in zip(rows.tolist(), first.tolist()):
                kept[r].append(int(pool[r, f]))
                a.append(int(here[r]))
                b.append(int(pool[r, f]))
                dist.append(d[r, f])
                late.append(k >= ANSWERED)
            between = 2 - 2 * np.einsum("rd,rcd->rc", vectors[rows, first], vectors[rows])
            open_[rows] &= ALPHA ** 2 * between > d[rows]
            open_[rows, first] = False
            open_[rows] &= pool[rows] != pool[rows, first][:, None]
        out += [np.array(k, np.int64) for k in kept]
    order = np.lexsort((dist, late, b))
    a, b, answered = np.array(a)[order], np.array(b)[order], ~np.array(late)[order]
    cuts = np.searchsorted(b, np.arange(m + 1))
    always = np.concatenate([[0], np.cumsum(answered)])
    return [np.union1d(own, a[s:min(e, s + max(DEGREE, int(always[e] - always[s])))]) for own, s, e in zip(out, cuts[:-1], cuts[1:])]


def graph(members):
    """(region, node, near, medoid): united neighbour lists of every member, and whether it is a shard's medoid."""
    sizes = materialize(members.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region-sizes")
    centres = materialize(centre_sets(members, sizes, SHARD / OVERLAP), "centres")
    dealt = near_centres(members.select("region", "node", "u"), centres, top=OVERLAP)
    shards = dealt.select("region", "node", "u", F.explode("child").alias("shard"))

    def build(frame):
        x, node = _matrix(frame["u"]), frame["node"].to_numpy()
        medoid = int((x @ x.sum(axis=0)).argmax())
        return pd.DataFrame({"region": frame["region"], "node": node, "near": [node[k] for k in pruned(x)], "medoid": np.arange(len(node)) == medoid})

    lists = shards.groupBy("region", "shard").applyInPandas(build, "region string, node long, near array<long>, medoid boolean")
    return lists.groupBy("region", "node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid"))


# ---------------------------------------------------------------- search

class Lists:
    """Neighbour lists as row numbers of the sorted ``node``, end to end."""

    def __init__(self, node, near):
        self.size = np.fromiter(map(len, near), np.int64, len(near))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.searchsorted(node, np.concatenate([np.zeros(0, np.int64)] + [np.asarray(k, np.int64) for k in near]))

    def of(self, rows, members):
        """(row, neighbour) for each neighbour of each member."""
        size = self.size[members]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(rows, size), self.flat[np.repeat(self.start[members], size) + step]


def greedy(q, x, lists, start, beam, least, slack):
    """Pairs (query, member) at a dot of ``least`` or more, found by beam search and range expansion."""
    n, m = len(q), len(x)
    seen = np.zeros((n, m), bool)
    found = []

    def look(rows, members):
        """Dots of pairs not seen before, each once."""
        fresh = ~seen[rows, members]
        key = np.unique(rows[fresh] * m + members[fresh])
        rows, members = key // m, key % m
        seen[rows, members] = True
        dots = np.empty(len(rows))
        for s in range(0, len(rows), PAIRS):
            dots[s:s + PAIRS] = np.einsum("pd,pd->p", q[rows[s:s + PAIRS]], x[members[s:s + PAIRS]])
        return rows, members, dots

    open_ = np.zeros((n, m), bool)  # within the slack and not expanded
    done = np.zeros((n, m), bool)
    at = np.full((n, beam), -1, np.int64)
    score = np.full((n, beam), -np.inf)
    rows, members, dots = look(np.repeat(np.arange(n), len(start)), np.tile(start, n))
    while True:
        found.append(np.stack([rows[dots >= least], members[dots >= least]]))
        wide = dots >= slack
        open_[rows[wide], members[wide]] = True
        # Merge what is new into the beams.
        cuts = np.searchsorted(rows, np.arange(n + 1))
        width = int(np.diff(cuts).max(initial=0))
        if width:
            new_at, new_score = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf)
            place = np.arange(len(rows)) - cuts[rows]
            new_at[rows, place], new_score[rows, place] = members, dots
            both_at, both = np.concatenate([at, new_at], axis=1), np.concatenate([score, new_score], axis=1)
            best = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
            at, score = np.take_along_axis(both_at, best, axis=1), np.take_along_axis(both, best, axis=1)
        waiting = (at >= 0) & ~done[np.arange(n)[:, None], at]
        ranked = np.where(waiting, score, -np.inf)
        pick = np.argsort(-ranked, axis=1)[:, :4]
        ok = np.take_along_axis(waiting, pick, axis=1)
        if not ok.any():
            break
        r, k = np.nonzero(ok)
        chosen = at[r, pick[r, k]]
        done[r, chosen] = True
        rows, members, dots = look(*lists.of(r, chosen))
    while True:
        r, k = np.nonzero(open_ & ~done)
        if not len(r):
            break
        step = max(1, PAIRS // int(lists.size.max()))
        for s in range(0, len(r), step):
            done[r[s:s + step], k[s:s + step]] = True
            rows, members, dots = look(*lists.of(r[s:s + step], k[s:s + step]))
            found.append(np.stack([rows[dots >= least], members[dots >= least]]))
            open_[rows[dots >= slack], members[dots >= slack]] = True
    return np.concatenate(found, axis=1)


def whole(q, x, least):
    """Pairs at a dot of ``least`` or more, by looking at all."""
    return np.stack(np.nonzero(q @ x.T >= least))


class Forest:
    """Smallest label of what is linked; edges come in arrays and leave as one star for each component."""

    def __init__(self, n):
        self.label = np.arange(n)

    def link(self, a, b):
        label = self.label
        while True:
            p, q = label[a], label[b]
            if np.array_equal(p, q):
                return
            low = np.minimum(p, q)
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    def stars(self):
        a = np.flatnonzero(self.label != np.arange(len(self.label)))
        return a, self.label[a]


def search(members, queries, lists, beam, similarity=SIMILARITY):
    """(node, n, to): for each query a row (node, weight found, null), for each forest edge a row (node, null, to).

    ``beam`` None compares regions whole.
    """
    slack = 1 - SLACK ** 2 * (1 - similarity)
    blocks = queries.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("g"))
    there = members.join(lists, ["region", "node"], "left").join(blocks, "region")
    there = there.select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("block"), "node", "w", "u", "near", "medoid")
    # In a region of one block each query meets itself; numbering by hash keeps the blocks even.
    asked = queries.join(blocks, "region").select("region", F.pmod(F.xxhash64("node"), F.col("g")).alias("block"), "node", "u")

    def run(key, m, q):
        out = {"node": [], "n": [], "to": []}
        if len(m) and len(q):
            m = m.sort_values("node", ignore_index=True)
            node, w, x, qn, y = m["node"].to_numpy(), m["w"].to_numpy(), _matrix(m["u"]), q["node"].to_numpy(), _matrix(q["u"])
            names, number = np.unique(np.concatenate([node, qn]), return_inverse=True)
            forest = Forest(len(names))
            total = np.zeros(len(qn), np.int64)
            if beam is not None:
                near, start = Lists(node, m["near"]), np.flatnonzero(m["medoid"].fillna(False).to_numpy(bool))
            for s in range(0, len(qn), CHUNK):
                part = y[s:s + CHUNK]
                r, k = whole(part, x, similarity) if beam is None else greedy(part, x, near, start, beam, similarity, slack)
                other = qn[s + r] != node[k]
                r, k = r[other], k[other]
                np.add.at(total, s + r, w[k])
                forest.link(number[len(node) + s + r], number[k])
            a, b = forest.stars()
            out = {"node": np.concatenate([qn, names[a]]), "n": np.concatenate([total, np.full(len(a), -1)]),
                   "to": np.concatenate([np.full(len(qn), -1), names[b]])}
        return pd.DataFrame(out).astype("int64")

    found = there.groupBy("region", "block").cogroup(asked.groupBy("region", "block")).applyInPandas(run, "node long, n long, `to` long")
    return found.select("node", F.when(F.col("n") >= 0, F.col("n")).alias("n"), F.when(F.col("to") >= 0, F.col("to")).alias("to"))


# ---------------------------------------------------------------- audit

def audit(classes, counts, similarity=SIMILARITY, audited=AUDIT):
    """The share of the links of up to ``audited`` classes that ``counts`` (node, n) has; 1.0 if they have none."""
    some = classes.select("part", "node", "u").orderBy(F.xxhash64("node"), "node").limit(audited).collect()  # at most AUDIT vectors
    parts = {}
    for r in some:
        parts.setdefault(r["part"], ([], []))
        parts[r["part"]][0].append(r["node"])
        parts[r["part"]][1].append(bytes(r["u"]))
    asked = {p: (np.array(n), _matrix(u)) for p, (n, u) in parts.items()}

    def run(batches):
        for batch in batches:
            part, node, w = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            u = batch.column(3).to_pylist()
            for name, (q, y) in asked.items():
                here = np.flatnonzero(part == name)
                if len(here):
                    near = (y @ _matrix([u[i] for i in here.tolist()]).T >= similarity) & (q[:, None] != node[here][None])
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(near @ w[here])], ["node", "true"])

    truth = classes.select("part", "node", "w", "u").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    both = truth.join(counts, "node", "left").agg(F.sum("true"), F.sum(F.coalesce("n", F.lit(0)))).first()
    return both[1] / both[0] if both[0] else 1.0


def efforts(dims):
    """(margin as a share of the radius, beam): three deviations of a random direction, half, and all of it."""
    return [(min(1.0, 3 / np.sqrt(max(1, dims))), 24), (0.6, 128), (1.0, None)]


def links(classes, similarity=SIMILARITY, target=TARGET):
    """((node, n), (a, b), audited recall): the weight of others linked to each class, and edges that connect what is linked."""
    radius = float(np.sqrt(2 - 2 * similarity))
    dims = classes.agg(F.max(F.length("u") / 8)).first()[0] or 1
    for share, beam in efforts(dims):
        members, queries = regions(classes, share * radius)
        lists = graph(members) if beam is not None else members.select("region", "node", F.lit(None).cast("array<long>").alias("near"), F.lit(False).alias("medoid"))
        found = materialize(search(members, queries, lists, beam, similarity), "links")
        counts = materialize(found.where("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n")), "link-counts")
        recall = audit(classes, counts, similarity)
        if recall >= target:
            break
    return counts, found.where("`to` IS NOT NULL").select(F.col("node").alias("a"), F.col("to").alias("b")), recall


def near_duplicates(vectors, vec_id="vec_id", embedding="embedding", label="label", similarity=SIMILARITY):
    """(vec_id, n_links, component_id, kept) for each row."""
    rows = materialize(units(vectors, vec_id, embedding, label), "units")
    linked = rows.where(F.col("u").isNotNull())
    # Written once, so that the numbers stay.
    classes = materialize(linked.groupBy("part", "u").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("first"))
                          .withColumn("node", F.monotonically_increasing_id()), "classes")
    counts, edges, _ = links(classes, similarity)
    roots = components(edges)
    labelled = classes.join(counts, "node", "left").join(roots.withColumnRenamed("root", "r"), "node", "left").select(
        "part", "u", "first", F.coalesce("r", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    heads = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(labelled.join(heads, "root").select("part", "u", "n_links", "component_id"), "named")
    joined = linked.join(named, ["part", "u"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("u").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
