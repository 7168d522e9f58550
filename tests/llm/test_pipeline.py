"""Registered queries and the pipeline on the smallest given tables, each stage against a plain version."""

import os
import re

import pytest

import __spark_entry__
import corpus_pipeline
from hosttrace.llm import pii_anchors, quality_gate, queries
from hosttrace.llm.common import table

from .data import documents
from .test_near_copies import plain_first
from .test_tokens import ids_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not present")


def test_registered():
    names = {*queries.queries(), "pipeline"}
    assert names <= set(__spark_entry__.queries()) and len(names) == 14
    assert set(queries.oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_archives_equal_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    got = queries.op6_warc_segments(spark, SF_DIR)
    want = con.execute(queries.oracle_sql()["op6_warc_segments"])
    names = [d[0] for d in want.description]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    labels = table(spark, SF_DIR, "labels")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR).cache()
        steps.append(out)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "packing"]
    source = {r["doc_id"]: r for r in table(spark, SF_DIR, "documents").collect()}

    kept = {r["doc_id"] for r in steps[0].collect()}
    cutoffs = quality_gate.fit(quality_gate.statistics(table(spark, SF_DIR, "documents")), labels)
    assert kept == {i for i, r in source.items() if quality_gate.verdict(r["text"] or "", r["lang"] or "", cutoffs)}

    single = {r["doc_id"] for r in steps[1].collect()}
    assert sorted(map(str, single)) == plain_first([(i, source[i]["text"]) for i in sorted(kept)])

    bench = [re.findall(r"\w+", r["text"].lower()) for r in table(spark, SF_DIR, "benchmark").collect()]

    def holds(text):
        line = " " + " ".join(re.findall(r"\w+", text.lower())) + " "
        return any(f" {' '.join(b)} " in line for b in bench)
    clean = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    assert set(clean) == {i for i in single if not holds(source[i]["text"])}

    masked = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    assert masked == {i: pii_anchors.masked(t) for i, t in clean.items()}
    assert not any(k in pii_anchors.BASE for t in masked.values() for k, _, _ in pii_anchors.find(t))

    tokens = {}
    for r in steps[4].collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {i: len(ids_of(t)) for i, t in masked.items()}


def test_stages_on_hard_rows(spark):
    docs = documents(spark, [(1, None), (None, "a b c d e f g h i j k l"), (2, ""), (2, ""), (3, "one two three four five six seven eight nine ten a@b.cd")])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert {r["doc_id"] for r in docs.collect()} == {None, 3}
