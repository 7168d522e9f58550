"""Covering tables and components against all pairs, leaks against plain windows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hosttrace.llm import covering_lsh, near_copies, template_leaks

from .data import documents, empty, hard_texts, prose


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius=2):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def partition(labels):
    seen = {}
    return [seen.setdefault(x, len(seen)) for x in labels]


def test_every_pair_within_the_radius_shares_a_table():
    masks = covering_lsh.covering_masks(range(64))
    assert len(masks) == 7 and all(m.bit_count() == 32 for m in masks)
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_forest_connects_what_is_linked():
    r = np.random.default_rng(5)
    for n, bits in ((2, 3), (10, 6), (40, 8), (100, 9), (300, 12)):
        x = np.unique(r.integers(0, 1 << bits, n).astype(np.uint64) << np.uint64(7))
        edges = covering_lsh.forest(x)
        assert all(int(x[a] ^ x[b]).bit_count() <= 2 for a, b in edges)
        label = list(range(len(x)))
        for a, b in edges:
            p, q = label[a], label[b]
            label = [p if v == q else v for v in label]
        assert partition(label) == partition(plain_components([int(v) for v in x]))


def test_fingerprints(spark):
    rows = hard_texts()
    got = covering_lsh.fingerprints(documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64)) for r in got) == sorted((str(i), plain_fingerprint(t)) for i, t in rows)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_of_dense_fingerprints(spark, bucket, monkeypatch):
    monkeypatch.setattr(covering_lsh, "BUCKET", bucket)
    r = np.random.default_rng(7)
    centres = r.integers(0, 1 << 63, 12)
    values = sorted({int(c) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(d)) for c in centres for a, b, d in r.integers(0, 63, (25, 3))} | {0, 1, 6, -1, -2})
    fps = spark.createDataFrame([(v,) for v in values], "fp long").repartition(4)
    found = {x["node"]: x["root"] for x in covering_lsh.components(covering_lsh.links(fps)).collect()}
    got = partition([found.get(v, v) for v in values])
    assert got == partition(plain_components([v % (1 << 64) for v in values]))


def test_long_chains_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["root"] for r in covering_lsh.components(edges).collect()}
    assert all(got.get(k, k) == 0 for k in range(301)) and got[1001] == 1000


def test_near_duplicates_and_one_of_each(spark):
    base = prose(11, 400)
    rows = hard_texts() + [(50, base), (51, base), (52, base.upper()), (40, base + " .")] + [(k, prose(k, 100)) for k in range(60, 80)]
    docs = documents(spark, rows)
    got = covering_lsh.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    values = [plain_fingerprint(t) for _, t in rows]
    least = {}
    for (i, _), c in zip(rows, plain_components(values)):
        least[c] = min(x for x in (least.get(c), i) if x is not None) if least.get(c) is not None or i is not None else None
    want = sorted((str(i), str(least[c])) for (i, _), c in zip(rows, plain_components(values)))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    kept = covering_lsh.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(str(v) for v in least.values())
    assert covering_lsh.near_duplicates(empty(docs)).collect() == []


def test_one_of_each_component_without_clear_ids(spark):
    """Near copies without an id are one component like any other; texts that share an id are each their component's."""
    base, other = prose(11, 400), prose(12, 400)
    rows = [(None, base), (None, base.upper()), (None, base + " ")] + [(None, None), (None, ""), (None, " "), (None, other), (3, other), (5, other), (5, prose(13, 90)), (6, prose(14, 90)), (6, prose(15, 90))]
    for given, more in (({}, []), ({"near": near_copies.rooted, "classes": near_copies.classes}, [(None, base + " .")])):
        docs = documents(spark, rows + more)
        kept = covering_lsh.one_of_each(docs, **given)
        assert kept.columns == docs.columns
        got = sorted((str(r["doc_id"]), (r["text"] or "").strip().lower()[:30]) for r in kept.collect())
        assert got == sorted([("None", base.lower()[:30]), ("None", ""), ("3", other.lower()[:30]), ("5", prose(13, 90).lower()[:30]),
                              ("6", prose(14, 90).lower()[:30]), ("6", prose(15, 90).lower()[:30])])
    assert covering_lsh.one_of_each(empty(docs)).collect() == []


QUESTION = "A train travels 120 miles in 3 hours from Boston towards Albany at a steady speed. How many miles does the train travel in 5 hours at the same speed?"


def leaks(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in template_leaks.leaks(documents(spark, docs), bench).collect()}


def test_leaks(spark):
    changed = QUESTION.replace("120", "90").replace("3 hours", "2 hours").replace("5 hours", "7 hours").replace("Boston", "Denver").replace("Albany", "Boulder")
    clash = QUESTION.replace("Boston", "Denver").replace("Albany", "Denver")
    docs = [(1, prose(1, 40) + ". " + QUESTION + " " + prose(2, 40)), (2, changed), (3, clash), (4, prose(9, 300)), (5, None), (6, ""),
            (7, "How many miles does the train"), (8, prose(4, 30) + ". " + changed), (8, prose(4, 30) + ". " + changed)]
    got = leaks(spark, docs, [(10, QUESTION), (11, None), (12, ""), (13, "Blue whales sing very low songs."), (10, QUESTION)])
    assert got == {(1, 10): "copied", (2, 10): "reparameterised", (8, 10): "reparameterised"}
    assert leaks(spark, docs, []) == {} and leaks(spark, [], [(10, QUESTION)]) == {}


def test_leaks_in_blocks_and_the_stage(spark, monkeypatch):
    docs = [(k, prose(k, 200)) for k in range(12)] + [(None, QUESTION)]
    items = [(k, " ".join(prose(k, 200).split()[40:90])) for k in range(0, 12, 3)] + [(99, QUESTION)]
    whole = leaks(spark, docs, items)
    monkeypatch.setattr(template_leaks, "BLOCK_HASHES", 50)
    assert leaks(spark, docs, items) == whole and {d for d, _ in whole} == {0, 3, 6, 9, None}
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, docs)
    kept = template_leaks.clean_documents(frame, bench)
    assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(k) for k in range(12) if k not in (0, 3, 6, 9))


def test_batches_follow_the_rule():
    texts = ["Anna ran 5 km. Then Bob ran 12 Miles\nBob 7\nkm x", "", "Single", "I paid $3.50 to NASA O'Neill's! two days x.y 3.4.5 a\x85b", prose(3, 200), "5", "km 5 ... Km"]
    texts += [t or "" for _, t in hard_texts()]
    tool = template_leaks.TemplateWords()
    for _ in range(2):
        codes, hashes, slot, ends = tool.templates([t.encode() for t in texts])
        places, h = template_leaks.window_hashes(hashes, ends)
        starts, at = [0, *ends[:-1].tolist()], 0
        for t, a, b in zip(texts, starts, ends.tolist()):
            words, values = template_leaks.canonical(t)
            assert hashes[a:b].tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
            assert [tool.names[c] if s else None for c, s in zip(codes[a:b], slot[a:b])] == values
            n = max(1, len(words) - 7) if words else 0
            assert places[at:at + n].tolist() == list(range(a, a + n))
            at += n
        assert at == len(h)
        windows = {}
        for p, x in zip(places.tolist(), h.tolist()):
            end = min(p + 8, int(ends[np.searchsorted(ends, p, side="right")]))
            windows.setdefault(tuple(hashes[p:end].tolist()), set()).add(x)
        assert all(len(v) == 1 for v in windows.values()) and len({x for v in windows.values() for x in v}) == len(windows)


def test_canonical():
    words, values = template_leaks.canonical("Anna ran 5 km. Then Bob ran twelve miles, and NASA won $3.50!")
    assert words == "anna ran <num> <unit> then <name> ran <num> <unit> and nasa won <num>".split()
    assert [v for v in values if v] == ["5", "km", "bob", "twelve", "miles", "$3.50"]
