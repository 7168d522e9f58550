"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is 1 if more than half of the text's shingle hashes have it. Two fingerprints link at ``RADIUS`` or
fewer differing bits. Masks come from a code: bit i carries the vector m(i) of r + 1 bits, and the mask of v keeps the
bits whose inner product with v is odd. Any r differing bits leave some v orthogonal to all their vectors, so under that
mask both fingerprints agree: every pair within the radius collides in one of the 2^(r+1) - 1 = 7 tables.

Only distinct fingerprints enter the tables. A bucket of more than ``BUCKET`` fingerprints is covered again over the
bits its mask left out, which bounds the new buckets at 2^16 fingerprints by their free bits alone. Inside a bucket no
pairs are listed: erasing any two free bits makes all fingerprints that differ in nothing else equal, so a spanning
forest of the links follows from sorting. Components grow by large-star and small-star rounds on written tables.

Defined cases: a null or blank text has fingerprint zero and links like any other; a null doc_id is kept in the result,
and a component's id is the smallest doc_id that is not null (null if there is none); repeated rows stay; other columns
are not read.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from hosttrace.llm.common import free_name, materialize, per_batch, utf8

RADIUS = 2
BITS = 64
BUCKET = 4096
SEED = 42


# ---------------------------------------------------------------- fingerprints

def fingerprint(text, words=3):
    """The fingerprint of one text given as bytes."""
    w = text.lower().split()
    if not w:
        return 0
    line, n = b" ".join(w), len(w)
    if n <= words:
        h = np.array([xxhash.xxh64_intdigest(line, SEED)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n - words + 1].tolist(), ends[words - 1:].tolist())], "<u8")
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[a:a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs, doc_id="doc_id", text="text", words=3):
    """(doc_id, fp) for each row; fp holds the 64 bits as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def one(batch):
        fp = np.array([fingerprint(t, words) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(per_batch(one), f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- masks

def covering_masks(places, radius=RADIUS):
    """One mask for each nonzero vector of radius + 1 bits over the given bit places."""
    top = 1 << (radius + 1)
    return [sum(1 << p for k, p in enumerate(places) if (k % top & v).bit_count() % 2) for v in range(1, top)]


def signed(mask):
    return mask - (1 << 64) if mask >> 63 else mask


def table_rows(fps):
    """(table, key, fp) for each fingerprint and mask, big buckets covered a second time."""
    masks = covering_masks(range(BITS))
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                                                for k, m in enumerate(masks)])).alias("r")).select("r.table", "r.key", "fp")
    sizes = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, ["table", "key"])
    again = []
    for k, m in enumerate(masks):
        free = [i for i in range(BITS) if not m >> i & 1]
        again.append(F.array(*[F.struct(F.lit((k + 1) * 100 + j).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m | s))).alias("key"))
                               for j, s in enumerate(covering_masks(free))]))
    small = rows.where(F.col("n") <= BUCKET).select("table", "key", "fp")
    choice = F.element_at(F.array(*again), F.col("table") + 1)
    big = rows.where(F.col("n") > BUCKET).select("fp", F.explode(choice).alias("r")).select("r.table", "r.key", "fp")
    return small.unionByName(big)


# ---------------------------------------------------------------- inside a bucket

def forest(x, radius=RADIUS):
    """A spanning forest of the links among distinct fingerprints (unsigned 64-bit), as index pairs."""
    n = len(x)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def link(a, b):
        p, q = root(a), root(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((a, b))

    if n <= 64:
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
        for a, b in np.argwhere(np.triu(near, 1)).tolist():
            link(a, b)
        return out
    differ = int(np.bitwise_or.reduce(x ^ x[0]))
    free = [i for i in range(BITS) if differ >> i & 1]
    for erased in combinations(free, min(radius, len(free))):
        y = x & np.uint64(~sum(1 << i for i in erased) & (1 << 64) - 1)
        order = np.argsort(y, kind="stable")
        z = y[order]
        for k in np.flatnonzero(z[1:] == z[:-1]).tolist():
            link(int(order[k]), int(order[k + 1]))
        if len(out) == n - 1:
            break
    return out


def links(fps):
    """Edges (a, b), a < b unsigned order aside, that connect all fingerprints within the radius."""
    rows = table_rows(fps).repartition("table", "key").sortWithinPartitions("table", "key")

    def run(batches):
        left = None

        def edges(keys, fp, last):
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate([[0], new, [len(keys)] if last else []]).astype(np.int64).tolist()
            x, a, b = fp.view(np.uint64), [], []
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s == 2:
                    if int(x[s] ^ x[s + 1]).bit_count() <= RADIUS:
                        a.append(fp[s])
                        b.append(fp[s + 1])
                elif e - s > 2:
                    for i, j in forest(x[s:e]):
                        a.append(fp[s + i])
                        b.append(fp[s + j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]), bounds[-1]

        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
            fp = batch.column(2).to_numpy(zero_copy_only=False)
            if left is not None:
                keys, fp = np.concatenate([left[0], keys]), np.concatenate([left[1], fp])
            if len(fp):
                out, at = edges(keys, fp, False)
                left = keys[at:], fp[at:]
                if out.num_rows:
                    yield out
        if left is not None and len(left[1]):
            yield edges(*left, True)[0]

    return rows.mapInArrow(run, "a long, b long").distinct()


# ---------------------------------------------------------------- components

def components(edges):
    """(node, root) for every node of the edges: the smallest node of its component.

    Alternating large-star and small-star rounds; each starts from a written table and they end when nothing changes.
    """
    def star(e, small):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if small:
            both = both.where("a > b")
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        joined = both.join(least, "a")
        near = joined.where("b != m") if small else joined.where("b > a")
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if small:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def summary(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    before = summary(e)
    while before[0]:
        e = materialize(star(star(e, False), True), "links")
        after = summary(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(docs, doc_id="doc_id", text="text", words=3):
    """(doc_id, fp, root, component_id) for each row; root tells components apart, also those without an id."""
    fps = materialize(fingerprints(docs, doc_id, text, words), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes.select("fp")))
    labelled = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(heads, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs, doc_id="doc_id", text="text", words=3):
    """(doc_id, fp, component_id) for each row."""
    return rooted(docs, doc_id, text, words).drop("root")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs, doc_id="doc_id", text="text", near=rooted, classes=fingerprints):
    """``docs`` with one row of each component: the document of its smallest id, where it has one.

    An id that no other row has tells its row. Rows that share an id, or have none, are told apart by their texts: of those
    with the component's id a row of the least text stays. ``near`` gives the components and their roots, ``classes`` the
    same fp of a text as ``near``.
    """
    found = near(docs, doc_id, text)
    copies, head, kept, same, blank = (free_name(docs, name) for name in ("copies", "head", "kept_id", "kept_text", "plain_text"))
    root, fp = free_name(docs, "root"), free_name(docs, "fp")
    is_head = F.col("doc_id") == F.col("component_id")
    named = (found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias(copies), F.max(is_head).alias(head))
             .where(F.col(head)).select(F.col("doc_id").alias(kept), copies))
    rows = docs.join(named, F.col(doc_id) == F.col(kept))
    single = rows.where(F.col(copies) == 1).select(*docs.columns)
    unclear = rows.where(F.col(copies) > 1).select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))
    unclear = materialize(unclear.withColumn(blank, F.coalesce(text, F.lit(""))).dropDuplicates([doc_id, blank]), "unclear-rows")
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(kept)).distinct()
    texts = classes(unclear.select(F.col(blank).alias("t")).distinct(), "t", "t").select(F.col("doc_id").alias(same), F.col("fp").alias(fp))
    meets = (F.col(blank) == F.col(same)) & F.col(doc_id).eqNullSafe(F.col(kept))
    there = unclear.select(F.col(doc_id).alias("id"), F.col(blank).alias("t"))
    chosen = (texts.join(heads, fp).join(there, (F.col("t") == F.col(same)) & F.col("id").eqNullSafe(F.col(kept)), "left_semi")
              .groupBy(root, kept).agg(F.min(same).alias(same)))
    return single.unionByName(unclear.join(chosen, meets, "left_semi").select(*docs.columns))
