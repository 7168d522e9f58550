"""Token operators against the tokenizer itself."""

import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hosttrace.llm import ans_store, length_histogram, packing
from hosttrace.llm.common import scratch_dir
from hosttrace.llm.tokens import WordEncoder, tokenizer_path

from .data import documents, empty, hard_texts, prose


def ids_of(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


def test_word_encoder_equals_the_tokenizer(monkeypatch):
    texts = [t or "" for _, t in hard_texts()] + ["ÉCOLE İstanbul ΣΑΣ Å å !!! a.b c... d.,", "it's THEY'LL 'tis x'd", "ß ŉ ǅ ﬁ 1st 2,3", "\x1c a\x85b  c", "x." * 300]
    tool = WordEncoder(tokenizer_path())
    for _ in range(2):
        ids, sizes = tool.encode([t.encode() for t in texts])
        ends = np.cumsum(sizes)
        for t, b, n in zip(texts, ends.tolist(), sizes.tolist()):
            assert ids[b - n:b].tolist() == ids_of(t), t[:50]
        monkeypatch.setattr(tool, "most", 3000)  # a table that is emptied again and again
        tool.forget()
    for k in range(30):
        ids, sizes = tool.encode([f"{prose(k, 50)} w{k}q{j}" .encode() for j in range(400)])
    assert sizes.sum() == len(ids)


def test_histogram_totals(spark):
    docs = documents(spark, hard_texts())
    lengths = sorted(len(ids_of(t)) - 1 for _, t in hard_texts())
    counts = length_histogram.length_counts(docs).cache()
    assert sorted(x for r in counts.collect() for x in [r["n_tokens"]] * r["n_docs"]) == lengths
    suffix = length_histogram.histogram(counts).cache()
    for r in suffix.collect():
        n = r["n_tokens"]
        assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["tokens_below"] == sum(x for x in lengths if x < n) and r["truncated_total"] == sum(min(x, n) for x in lengths)
    limits = [0, 1, 5, 64, 100, 2048, 10 ** 6]
    for r in length_histogram.at_limits(suffix, limits).collect():
        n = r["context"]
        assert r["truncated_total"] == sum(min(x, n) for x in lengths) and r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_lost"] == sum(max(0, x - n) for x in lengths)
    q = length_histogram.quantiles(suffix, [0.25, 0.5, 1.0]).first()
    assert [q["q0.25"], q["q0.5"], q["q1"]] == [lengths[int(np.ceil(s * len(lengths))) - 1] for s in (0.25, 0.5, 1.0)]


def test_histogram_of_nothing(spark):
    counts = length_histogram.length_counts(empty(documents(spark, hard_texts())))
    suffix = length_histogram.histogram(counts)
    assert suffix.collect() == [] and length_histogram.quantiles(suffix, [0.5]).first()[0] is None
    assert [tuple(r)[1:] for r in length_histogram.at_limits(suffix, [10]).collect()] == [(0, 0, 0, 0)]


@pytest.mark.parametrize("stream", [1 << 20, 5000])
def test_packing_covers_every_id_once(spark, stream, monkeypatch):
    monkeypatch.setattr(packing, "STREAM_TOKENS", stream)
    rows = hard_texts() + [(k, prose(k, 150)) for k in range(20, 120)]
    got = packing.pack(documents(spark, rows).coalesce(1)).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert pieces[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(pieces, pieces[1:]))
        assert sum(p["length"] for p in pieces) == pieces[0]["used"] <= 2048
    want, have = [], []
    for i, t in rows:
        want += [(str(i), k, x) for k, x in enumerate(ids_of(t))]
    by_key = {(str(i), len(ids_of(t))): ids_of(t) for i, t in rows}
    for r in got:
        part = by_key[str(r["doc_id"]), r["doc_tokens"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        have += [(str(r["doc_id"]), r["start"] + k, x) for k, x in enumerate(part)]
    assert sorted(have) == sorted(want)
    used = [p[0]["used"] for p in sequences.values()]
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in used) < 0.05 * sum(used) + 2048
    assert packing.pack(empty(documents(spark, rows))).collect() == []


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(3)
    for _ in range(60):
        width, n = 16, int(r.integers(2, 12))
        places = np.concatenate([[0], np.cumsum(r.integers(1, 9, n))]).astype(np.int64)
        costs = np.concatenate([[0.0], r.integers(0, 5, n).astype(float)])
        costs[-1] = 0

        def pad(k):
            return 0 if k & (k - 1) == 0 else width - k
        best = [0.0] + [np.inf] * n
        for j in range(1, n + 1):
            best[j] = min((best[i] + pad(int(places[j] - places[i])) + costs[j] + 2.0 for i in range(j) if places[j] - places[i] <= width), default=np.inf)
        cuts = packing.best_cuts(places, costs, width, 2.0)
        total = sum(pad(int(places[b] - places[a])) + costs[b] + 2.0 for a, b in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == n and abs(total - best[n]) < 1e-9


def test_coder_round_trip_and_checkpoints(monkeypatch):
    monkeypatch.setattr(ans_store, "CHECKPOINT", 4096)
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 20_000):
        ids = np.minimum(r.geometric(0.01, n), 5000).astype(np.uint16)
        c = ans_store.Coder(ans_store.scaled_frequencies(np.bincount(ids, minlength=6000)))
        data = ans_store.write_block(c, 3, 9, [4, None], [n, 0], ids)
        block, end = ans_store.read_block(memoryview(data + b"\n"))
        assert end == len(data) and block["doc_ids"] == [4, None] and (block["part"], block["number"]) == (3, 9)
        assert (ans_store.decode_block(c, block) == ids).all()
        for k, (a, _, _) in enumerate(block["marks"]):
            part = ans_store.decode_from(c, block, k)
            assert (part == ids[a:a + len(part)]).all()
    with pytest.raises(ValueError):
        ans_store.read_block(data[:-1] + bytes([data[-1] ^ 1]))


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(ans_store, "BLOCK_IDS", 3000)
    rows = hard_texts() + [(k, prose(k, 40)) for k in range(20, 60)]
    docs = documents(spark, rows)
    folder = ans_store.write_store(docs, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    read = ans_store.read_store(spark, folder, with_ids=True).cache()
    got = ans_store.with_starts(read).orderBy("start").collect()
    assert sorted(((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got)) == sorted((str(i), ids_of(t)) for i, t in rows)
    at, last = 0, None
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
        assert last is None or r["doc_id"] >= last
        last = r["doc_id"]
    assert ans_store.round_trip(empty(docs)).collect() == []
    assert read.select(F.min("doc_id")).first()[0] == 0
