"""Quality gate, toxicity and personal data against plain versions."""

import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hosttrace.llm import counterfactual_toxicity, pii_anchors, quality_gate

from .data import documents, empty, hard_texts, prose


# ---------------------------------------------------------------- quality

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "C", "é|", "#", "\n", "\t", "a\x1cb", " ", "a b\n", "x\x85"]), max_size=60))
def test_base_counts(parts):
    text = " ".join(parts) + "".join(parts)
    assert quality_gate.base_counts(text)[:5] == plain_counts(text)


def test_base_counts_of_many_words():
    words = [f"w{k}" for k in range(9000)]
    text = " ".join(words + words[100:107] + ["z"] + words[100:106])
    assert quality_gate.base_counts(text)[4] == 7 + 7 + 6


def test_bounds_are_exact():
    def tail(k, n, p):
        return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, delta in ((0, 20, 0.05), (3, 50, 0.01), (10, 400, 0.025), (49, 50, 0.1)):
        p = quality_gate.upper_bound(k, n, delta)
        assert abs(tail(k, n, p) - delta) < 1e-6
        assert quality_gate.within(k, n, p + 1e-4, delta) == (k < n * (p + 1e-4)) and not quality_gate.within(k, n, p - 1e-4, delta)
    assert quality_gate.upper_bound(5, 5, 0.05) == 1.0 and not quality_gate.within(0, 0, 0.5, 0.5)


def junk(k):
    words = prose(k, 60).split()
    return [" ".join(w + "***" for w in words), " ".join(words).upper().replace(" ", "!! "), " | ".join(words)][k % 3]


def labelled(spark, n):
    rows = [(k, junk(k) if k % 5 == 0 else prose(k, 60)) for k in range(n)]
    docs = documents(spark, rows + [(None, junk(1)), (n + 1, None), (n + 2, junk(2))])
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(n)] + [(3, None), (None, 0), (10 ** 6, 1)], "doc_id long, quality int")
    return docs, labels


def test_gate_rejects_junk_and_keeps_good(spark):
    docs, labels = labelled(spark, 700)
    got = {r["doc_id"]: r for r in quality_gate.assess(docs, labels).collect()}
    assert sum(got[k]["kept"] for k in range(700) if k % 5) >= 555 and not any(got[k]["kept"] for k in range(0, 700, 5))
    assert not got[702]["kept"] and got[702]["rejected_by"] and got[701]["base_failed"] and not got[None]["kept"]
    kept = quality_gate.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}


def test_gate_without_enough_labels(spark):
    docs, labels = labelled(spark, 40)
    rows = quality_gate.assess(docs, labels).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)  # no cutoff can be certified
    assert quality_gate.assess(empty(docs), labels).collect() == [] and quality_gate.assess(docs, empty(labels)).count() == 43


def test_cutoffs_keep_their_promise():
    """Over many draws of labels, a selected point of the path exceeds the risk no more often than delta allows."""
    r, failures = np.random.default_rng(2), 0
    path = [200, 150, 120, 100, 90, 80, 70, 60, 50, 40, 30, 20]
    level = quality_gate.levels(path)
    true = [np.mean(np.arange(201) > c) for c in path]
    for _ in range(300):
        good, bad = r.integers(0, 201, 400), np.full(100, 200)
        counts = [("en", q, level[s], 1) for q, values in ((1, good), (0, bad)) for s in values]
        point = quality_gate.select({"en": None}, counts, risk=0.6, delta=0.1).get("en")
        failures += point is not None and true[point] > 0.6
    assert failures <= 45


# ---------------------------------------------------------------- toxicity

@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_toxicity(spark, broadcast, monkeypatch):
    monkeypatch.setattr(counterfactual_toxicity, "BROADCAST_LABELS", broadcast)

    def text(k):
        t = prose(k, 50)
        if k % 4 == 0:
            t += " you " + ["idiot", "moron", "scum"][k % 3]
            t += " muslim people" if k % 8 == 0 else ""
        return t + (" muslim" if k % 40 == 1 else "")
    rows = [(k, text(k)) for k in range(1200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(1200)] + [(5, None), (None, 1), (7, 9)], "doc_id long, toxic int")
    docs = documents(spark, rows + [(None, None), (2000, ""), (2001, "muslim women walk"), (2002, "such an idiot"), (2003, "the river")])
    model = counterfactual_toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in counterfactual_toxicity.score(docs, model).collect()}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert [k for k in range(1200) if got[k]["held_out"]] == held
    assert np.mean([got[k]["predicted"] == (k % 4 == 0) for k in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[2002]["predicted"] == 1 and got[2001]["predicted"] == 0
    plain = counterfactual_toxicity.fit(docs, labels, penalty=0.0)
    w = lambda m: m["weights"][m["index"]["muslim"]]
    assert abs(w(model)) < abs(w(plain))
    assert counterfactual_toxicity.score(empty(docs), model).collect() == []
    none = counterfactual_toxicity.fit(docs, empty(labels))
    assert {r["score"] for r in counterfactual_toxicity.score(docs, none).collect()} == {0.5}


def test_fit_ignores_held_out_labels(spark):
    rows = [(k, prose(k, 30) + (" scum" if k % 3 == 0 else "")) for k in range(300)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(counterfactual_toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (counterfactual_toxicity.fit(docs, x) for x in (labels, turned))
    assert a["index"] == b["index"] and np.allclose(a["weights"], b["weights"], atol=1e-6)


# ---------------------------------------------------------------- personal data

def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii_anchors.KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("ab.@-1 _%", max_size=40), st.text("0123456789 -.", max_size=50), st.text("+1 (2)-3.456é@", max_size=50), st.text("12.", max_size=30)))
def test_base_spans(text):
    assert [s for s in pii_anchors.find(text) if s[0] in pii_anchors.BASE] == plain_spans(text)


def test_added_spans():
    def kinds(t):
        return [(k, t[s:e]) for k, s, e in pii_anchors.find(t) if k not in pii_anchors.BASE]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00.") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00.") == [] and kinds("DE89370400440532013000") == []
    assert kinds("SSN 123-45-6789, SSN 000-45-6789") == [("account", "123-45-6789")]
    assert kinds("see https://user:pw@host.example/x and http://host.example/@me:x") == [("url", "https://user:pw@host.example/x")]
    assert kinds("write to jo.doe (at) mail [dot] example (dot) org now") == [("address", "jo.doe (at) mail [dot] example (dot) org")]
    assert kinds("my iban: de89370400440532013000, Iban: GB82 WEST 1234 5698 7654 32, ssn 123-45-6789") == [
        ("account", "de89370400440532013000"), ("account", "GB82 WEST 1234 5698 7654 32"), ("account", "123-45-6789")]
    assert kinds("Account number: 0012 3456 78, acct 12345, Routing No. 021000021, routing no. 021000022") == [("account", "0012 3456 78"), ("account", "021000021")]
    assert kinds('token = "04dbebab91ab85687d33" and API_KEY: sk4aZ91bb02cc_x, password is long, secret: abcdefghijklmno') == [
        ("secret", "04dbebab91ab85687d33"), ("secret", "sk4aZ91bb02cc_x")]
    assert kinds("http://a.b?u=https://me:pw@host/x http://x:y@z") == [("url", "https://me:pw@host/x"), ("url", "http://x:y@z")]
    assert kinds("İİ IBAN: DE89370400440532013000")[0][1].startswith("DE89")
    assert kinds("meet me (at) noon. The sum is 4-5-6 for account 7") == []


def test_detect_and_redact(spark):
    rows = hard_texts() + [(100, "mail é a.b@c.de or 10.0.0.1, 4111 1111 1111 1111; +1 (555) 555-0100" + " x" * 30_000 + " q@r.st")]
    docs = documents(spark, rows)
    got = {(r["doc_id"], r["spans"]): r for r in pii_anchors.detect(docs).collect()}
    for i, t in rows:
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(t or ""))
        r = got[i, text]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii_anchors.BASE] == [sum(s[0] == k for s in plain_spans(t or "")) for k in pii_anchors.BASE]
    clean = pii_anchors.redact(docs)
    assert clean.columns == docs.columns
    text = {r["doc_id"]: r for r in clean.collect()}
    assert text[100]["text"].startswith("mail é <email> or <ip>, <card>; <phone>") and text[100]["text"].endswith(" x <email>")
    assert text[100]["n_chars"] == len(text[100]["text"]) and text[1]["text"] == prose(1, 60)
    assert pii_anchors.detect(empty(docs)).collect() == []


@pytest.mark.parametrize("unit", ["http://", "http://a:b", "@", "a@", "+1", "1.1", "1.1.1.1.", "1 ", "1-", "12", "IBAN DE", "iban: ", "ssn ", "(at)", "a(at)b", "a(at)b(dot)",
                                  "token=", "token = \"", "account no ", "acct 1-", "https://a:b@", "x", " ", "é"])
def test_a_megabyte_of_any_anchor_is_linear(unit):
    text = unit * (1_000_000 // len(unit))
    start = time.perf_counter()
    pii_anchors.find(text)
    assert time.perf_counter() - start < 8
