"""Periodic runs against a plain scan of every lag."""

import hashlib
import random
import time
import zlib

from hosttrace.llm import periodic_runs, queries
from hosttrace.llm.common import table

from .data import documents, empty, hard_texts, prose


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
    return sorted([(s, e - s, q) for (s, e), q in out.items()], key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and w and h % 10 == 0:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_runs_equal_plain_scan():
    r = random.Random(1)
    for _ in range(6000):
        n, k = r.randrange(60), r.choice([1, 2, 2, 3, 5, 12])
        w = [bytes([97 + r.randrange(k)]) for _ in range(n)]
        for _ in range(r.randrange(3) if n > 8 else 0):
            a, p = r.randrange(n), r.randrange(1, 8)
            for i in range(a + p, min(n, a + r.randrange(n))):
                w[i] = w[i - p]
        assert periodic_runs.runs(w) == plain_runs(w), w


def test_splitting_keeps_every_run_and_stops_anywhere(monkeypatch):
    r = random.Random(2)
    lists = [[bytes([97 + min(r.randrange(9), r.randrange(9))]) for _ in range(300)] for _ in range(40)]
    whole = [periodic_runs.runs(w) for w in lists]
    monkeypatch.setattr(periodic_runs, "DEPTH", 1)
    assert [periodic_runs.runs(w) for w in lists] == whole == [plain_runs(w) for w in lists]


def test_hash_collisions_do_not_matter(monkeypatch):
    """With a constant hash every block looks equal; the words decide."""
    monkeypatch.setattr(periodic_runs, "powers", lambda n: periodic_runs.np.zeros(n, periodic_runs.np.uint64))
    r = random.Random(3)
    for _ in range(300):
        w = [bytes([97 + r.randrange(2)]) for _ in range(r.randrange(50))]
        assert periodic_runs.runs(w) == plain_runs(w)


def test_rows_equal_plain_rows(spark):
    rows = hard_texts() + [(i, prose(i, 20 + i)) for i in range(100, 400)]
    rows += [(500, "a " * 500), (501, "a b " * 300 + "c " * 6), (502, "stop go go stop " * 40), (503, "\x0ba\x0ca\x0da\x0aa\x09a a a a")]
    docs = documents(spark, rows)
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain_row(*r)) for r in rows)
    assert periodic_runs.periodic_runs(empty(docs)).collect() == []


def test_query_equals_plain_rows(spark):
    docs = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    docs = [r for r in docs if len(r[1] or "") < 20_000]
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert [got[i] for i, _ in docs] == [plain_row(*r) for r in docs]


def test_long_texts_are_not_quadratic():
    a, b = prose(7, 20_000).encode().split(), prose(8, 400).encode().split()
    for w in ([b"a"] * 200_000, [b"a", b"b"] * 100_000, a * 5, ([b"a"] * 6 + [b"b"] * 6) * 8_000, b * 300):
        start = time.perf_counter()
        assert periodic_runs.runs(w)
        assert time.perf_counter() - start < 20
