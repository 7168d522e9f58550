"""Registered queries against their SQL on the smallest given tables."""

import math
import os

import pytest

from hosttrace.checks import catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# One or more per area; every registered query can be named here.
CHECKED = [
    "a1_process_features", "a2_guid_only_features", "a4_prefix_features", "a5_behaviour_at_age", "a6_sibling_context",
    "a8_process_network", "a9_beacon_regularity", "a13_sensor_gap", "a21_label_audit", "f1_entropy", "f8_evidence",
    "g1_depth_and_root_image", "g2_label_by_lineage", "g5_lineage_root", "g9_lineage_status",
    "j2_enrich_with_pid_fallback", "j4_clock_offset", "j5_one_to_one_match", "j5_contested_match", "m15_local_outlier_factor",
    "m18_benign_threshold", "m18_other_group_threshold", "m21_roc_auc", "p9_schema_differences", "s4_event_ids", "p10_input_violations", "s3_parse_event_lines", "s12_tail_log", "t3_timed_scans",
    "t6_alert_payload", "w5_window_alerts",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert got == expected and got
