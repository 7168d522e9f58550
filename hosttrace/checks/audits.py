"""Audits, inventories and cleaning on the telemetry projection."""

from pyspark.sql import functions as F

from hosttrace.checks.features import EVIDENCE, RULES, _features_sql
from hosttrace.checks.registry import KEY, NODE, check, r6, rounded, with_ev
from hosttrace.checks.relations import _PROCS
from hosttrace.checks.telemetry import table, telemetry, telemetry_table
from hosttrace.functions import numeric, text
from hosttrace.operators import audit, clean, encode, label, metrics, relations, splits
from hosttrace.operators.features import process_features
from hosttrace.schema import DERIVED_DROP, DROP_BEFORE_FIT, LEAKY_COLS, PROCESS_FEATURES, PROCESS_KEY

_REPORTED = ["record_id", "UtcTime", "EventID", "platform", "run_id", "session", "computer", "ProcessGuid", "ProcessId", "Image", "User",
             "CommandLine", "CurrentDirectory", "ParentProcessGuid", "ParentProcessId", "ParentImage", "ParentCommandLine", "Protocol",
             "SourceIp", "SourcePort", "DestinationIp", "DestinationPort", "TargetFilename", "TargetObject", "Device", "label", "size"]
_LOGGED = [c for c in _REPORTED if c not in ("record_id", "UtcTime", "size")]


def _per_column(template, columns=_REPORTED):
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@check("a10_fill_report", with_ev(_per_column(
    "SELECT '{c}' AS \"column\", count({c}) AS filled, round(count({c}) * 100.0 / count(*), 6) AS pct, "
    "count({c}) = 0 AS empty FROM ev")))
def a10(spark, sf):
    return rounded(audit.fill_report(telemetry(spark, sf).select(*_REPORTED)))


@check("a11_field_inventory", with_ev(_per_column(
    "SELECT EventID, '{c}' AS name, count(*) AS present, count(*) FILTER (WHERE trim({c}) NOT IN ('', '-')) AS useful, "
    "count(*) FILTER (WHERE trim({c}) NOT IN ('', '-')) = 0 AS always_empty FROM ev GROUP BY EventID", _LOGGED)
    .replace("trim(", "trim(CAST(").replace(") NOT IN", " AS VARCHAR)) NOT IN")))
def a11(spark, sf):
    e = telemetry(spark, sf)
    return audit.field_inventory(e.select("EventID", F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in _LOGGED])).alias("f"))
        .select("EventID", "f.*"))


@check("a12_label_crosstab", with_ev("""
SELECT EventID, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS malicious,
       count(*) AS n FROM ev GROUP BY EventID"""))
def a12(spark, sf):
    return audit.label_crosstab(telemetry(spark, sf))


@check("a12_run_sizes", with_ev(f"SELECT run_id, count(*) AS events, {r6('avg(label)', 'malicious_rate')} FROM ev "
                                "GROUP BY run_id"))
def a12_runs(spark, sf):
    return rounded(audit.run_sizes(telemetry(spark, sf)))


_MISSING = """gaps AS (SELECT * FROM (SELECT DISTINCT EventID FROM ev), (SELECT DISTINCT run_id FROM ev)
    EXCEPT SELECT DISTINCT EventID, run_id FROM ev)"""


@check("a13_sensor_gap", with_ev("SELECT EventID, run_id FROM gaps", _MISSING))
def a13(spark, sf):
    return audit.sensor_gaps(telemetry(spark, sf))


@check("a13_sensor_gap_counts", with_ev("SELECT EventID, count(*) AS n_missing FROM gaps GROUP BY EventID", _MISSING))
def a13_counts(spark, sf):
    return audit.sensor_gap_counts(telemetry(spark, sf))


@check("a14_host_purity", with_ev("""
SELECT computer, count(*) AS n, count(*) FILTER (WHERE label = 1) AS malicious,
       round(100.0 * count(*) FILTER (WHERE label = 1) / count(*), 6) AS malicious_pct,
       count(DISTINCT label) = 1 AS single_label FROM ev GROUP BY computer"""))
def a14(spark, sf):
    return rounded(audit.host_purity(telemetry(spark, sf)))


@check("a14_empty_command_purity", with_ev("""
SELECT *, purity_pct > 90 AS leaks FROM (SELECT *, round(100.0 * greatest(benign, malicious) / empty, 6) AS purity_pct
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE CommandLine IS NULL) AS empty,
      count(*) FILTER (WHERE CommandLine IS NULL AND label = 0) AS benign,
      count(*) FILTER (WHERE CommandLine IS NULL AND label = 1) AS malicious FROM ev))"""))
def a14_empty(spark, sf):
    return rounded(audit.empty_command_purity(telemetry(spark, sf)))


_GAPS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 100.0 * count({c}) FILTER (WHERE platform = 'linux') / count(*) FILTER "
    f"(WHERE platform = 'linux') AS linux, 100.0 * count({c}) FILTER (WHERE platform = 'windows') / count(*) FILTER "
    f"(WHERE platform = 'windows') AS windows FROM ev" for c in _REPORTED if c != "platform")


@check("a16_fill_gap", with_ev(f"""
SELECT "column", round(linux, 6) AS linux, round(windows, 6) AS windows, round(abs(linux - windows), 6) AS gap
FROM ({_GAPS}) WHERE abs(linux - windows) >= 20"""))
def a16(spark, sf):
    return rounded(audit.fill_gap(telemetry(spark, sf), "linux", "windows", [c for c in _REPORTED if c != "platform"]))


@check("a17_label_share_gap", with_ev("""
SELECT round(linux, 6) AS linux, round(windows, 6) AS windows, round(abs(linux - windows), 6) AS gap,
       abs(linux - windows) >= 15 AS leaks FROM (SELECT 100 * avg(label) FILTER (WHERE platform = 'linux') AS linux,
       100 * avg(label) FILTER (WHERE platform = 'windows') AS windows FROM ev)"""))
def a17(spark, sf):
    return rounded(audit.label_share_gap(telemetry(spark, sf), "linux", "windows"))


@check("a17_merge_verdict", with_ev("""
SELECT 'label_share_gap' AS reason, round(abs(linux - windows), 6) AS value FROM (
    SELECT 100 * avg(label) FILTER (WHERE platform = 'linux') AS linux, 100 * avg(label) FILTER (WHERE platform = 'windows') AS windows
    FROM ev) WHERE abs(linux - windows) >= 15
UNION ALL SELECT 'one_sided_event_ids', CAST(count(*) AS DOUBLE) FROM (SELECT EventID FROM ev GROUP BY EventID
    HAVING count(DISTINCT platform) = 1) HAVING count(*) > 0"""))
def a17_verdict(spark, sf):
    return rounded(audit.merge_verdict(telemetry(spark, sf), "linux", "windows"))


_SHARES = """shares AS (SELECT computer, EventID, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY computer) AS pct
    FROM ev GROUP BY computer, EventID), pooled AS (SELECT EventID, 100.0 * count(*) / sum(count(*)) OVER () AS pooled FROM ev
    GROUP BY EventID), grid AS (SELECT computer, EventID, pooled, coalesce(pct, 0) AS pct
    FROM (SELECT DISTINCT computer FROM ev) CROSS JOIN pooled LEFT JOIN shares USING (computer, EventID))"""


@check("a18_distance_to_pooled", with_ev(
    "SELECT computer, round(sum(abs(pct - pooled)), 6) AS distance FROM grid GROUP BY computer", _SHARES))
def a18(spark, sf):
    return rounded(audit.distance_to_pooled(telemetry(spark, sf), "computer"))


@check("a18_host_pair_distances", with_ev("""
SELECT x.computer AS a, y.computer AS b, round(sum(abs(x.pct - y.pct)), 6) AS distance
FROM grid x JOIN grid y ON x.EventID = y.EventID AND x.computer < y.computer GROUP BY ALL""", _SHARES))
def a18_pairs(spark, sf):
    return rounded(audit.host_pair_distances(telemetry(spark, sf), "computer"))


_BY_OS = """os AS (SELECT EventID, coalesce(100.0 * count(*) FILTER (WHERE platform = 'linux')
    / (SELECT count(*) FROM ev WHERE platform = 'linux'), 0) AS a, coalesce(100.0 * count(*) FILTER
    (WHERE platform = 'windows') / (SELECT count(*) FROM ev WHERE platform = 'windows'), 0) AS b
    FROM ev GROUP BY EventID)"""


@check("a18_composition_difference", with_ev(
    "SELECT EventID, round(a, 6) AS pct_a, round(b, 6) AS pct_b, round(b - a, 6) AS difference FROM os", _BY_OS))
def a18_diff(spark, sf):
    e = telemetry(spark, sf)
    return rounded(audit.composition_difference(audit.event_shares(e.where("platform = 'linux'")),
                                                audit.event_shares(e.where("platform = 'windows'"))))


@check("a18_composition_distance", with_ev("SELECT round(sum(abs(a - b)), 6) AS distance FROM os", _BY_OS))
def a18_total(spark, sf):
    e = telemetry(spark, sf)
    return rounded(audit.composition_distance(audit.event_shares(e.where("platform = 'linux'")),
                                              audit.event_shares(e.where("platform = 'windows'"))))


def _side(name, where):
    return (f"(SELECT EventID, count(*) AS {name}_n, 100.0 * count(*) / (SELECT count(*) FROM ev WHERE {where}) "
            f"AS {name}_pct, 100.0 * avg(label) AS {name}_malicious_pct FROM ev WHERE {where} GROUP BY EventID)")


@check("a19_dataset_comparison", with_ev(f"""
SELECT EventID, coalesce(ours_n, 0) AS ours_n, {r6('coalesce(ours_pct, 0)', 'ours_pct')},
       {r6('coalesce(ours_malicious_pct, 0)', 'ours_malicious_pct')}, coalesce(other_n, 0) AS other_n,
       {r6('coalesce(other_pct, 0)', 'other_pct')}, {r6('coalesce(other_malicious_pct, 0)', 'other_malicious_pct')}
FROM {_side("ours", "platform = 'windows'")} FULL JOIN {_side("other", "platform = 'linux'")} USING (EventID)"""))
def a19(spark, sf):
    e = telemetry(spark, sf)
    return rounded(audit.dataset_comparison(e.where("platform = 'windows'"), e.where("platform = 'linux'")))


_MAL = "mal AS (SELECT * FROM evidence WHERE label = 1)"


@check("a20_evidence_tiers", with_ev("""
SELECT CASE WHEN tier = 'none' THEN 'LINEAGE' ELSE tier END AS tier, count(*) AS n,
       round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM mal GROUP BY 1""", RULES, EVIDENCE, _MAL))
def a20(spark, sf):
    return rounded(audit.evidence_tiers(telemetry_table(spark, sf)))


@check("a20_evidence_samples", with_ev("""
SELECT tier, technique, CAST(rank AS BIGINT) AS rank, EventID, evidence FROM (
    SELECT *, row_number() OVER (PARTITION BY tier, technique ORDER BY record_id) AS rank FROM mal WHERE tier <> 'none')
WHERE rank <= 6""", RULES, EVIDENCE, _MAL))
def a20_samples(spark, sf):
    rows = audit.evidence_samples(telemetry_table(spark, sf))
    return rows.withColumn("rank", F.col("rank").cast("long"))


_TIER = "CASE tier WHEN 'DIRECT' THEN 3 WHEN 'PARENT' THEN 2 WHEN 'OSBOOK' THEN 1 ELSE 0 END"
_AUDIT = f"""best AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY {_TIER} DESC, record_id) AS rn
    FROM evidence), sandbox AS (SELECT {NODE} AS node, max(CASE WHEN regexp_matches(concat_ws('#', Image, CommandLine,
    CurrentDirectory, ParentImage, ParentCommandLine, TargetFilename), '(?i)lab_sandbox') THEN 1 ELSE 0 END)
    AS sandbox_ref, max(CASE WHEN EventID = 1 THEN 1 ELSE 0 END) AS has_create, count(*) AS n_events,
    replace(min(session), '_win', '') AS scenario FROM ev GROUP BY {KEY}), audit AS (SELECT p.node, b.platform, p.label,
    scenario, CASE WHEN scenario LIKE 'benign%' THEN 0 ELSE 1 END AS attack_run, tier, technique, evidence,
    sandbox_ref, has_create, n_events, CASE WHEN p.parent IS NULL THEN 'no_parent_info' WHEN q.node IS NOT NULL
    THEN 'observed' ELSE 'parent_not_logged' END AS parent_status
    FROM procs p LEFT JOIN procs q ON q.node = p.parent JOIN sandbox s ON s.node = p.node
    JOIN best b ON {NODE.replace('platform', 'b.platform').replace('run_id', 'b.run_id').replace('ProcessGuid', 'b.ProcessGuid')} = p.node AND b.rn = 1),
    strong AS (SELECT *, CASE WHEN sandbox_ref = 1 OR (tier = 'DIRECT' AND technique NOT IN (SELECT technique FROM audit
    WHERE attack_run = 0 AND tier = 'DIRECT')) THEN 1 ELSE 0 END AS strong_evidence FROM audit)"""
_AUDITED = (RULES, EVIDENCE, _PROCS, _AUDIT)


def _audited(spark, sf):
    return audit.with_strong_evidence(audit.audit_processes(telemetry_table(spark, sf)))


_AUDIT_COLS = ["node", "label", "scenario", "tier", "technique", "evidence", "sandbox_ref", "has_create", "n_events",
               "parent_status", "strong_evidence"]


@check("a21_label_audit", with_ev(f"SELECT {', '.join(_AUDIT_COLS)} FROM strong", *_AUDITED))
def a21(spark, sf):
    return _audited(spark, sf).select(*_AUDIT_COLS)


_GROUPS = {"benign_run": "attack_run = 0", "attack_run_label0": "attack_run = 1 AND label = 0",
           "attack_run_label1": "attack_run = 1 AND label = 1"}


@check("a21_evidence_specificity", with_ev("SELECT CASE WHEN technique = '' THEN '(none)' ELSE technique END "
       "AS technique, " + ", ".join(
           f"round(100.0 * count(*) FILTER (WHERE {w}) / (SELECT greatest(count(*), 1) FROM strong WHERE {w}), 2) AS {g}"
           for g, w in _GROUPS.items()) + " FROM strong GROUP BY 1", *_AUDITED))
def a21_specificity(spark, sf):
    return audit.evidence_specificity(_audited(spark, sf))


@check("a21_audit_summary", with_ev("""
SELECT count(*) AS processes, count(*) FILTER (WHERE label = 1) AS malicious, count(*) FILTER (WHERE label = 0) AS benign,
 count(*) FILTER (WHERE label = 1 AND (tier <> 'none' OR sandbox_ref = 1)) AS malicious_with_evidence,
 count(*) FILTER (WHERE label = 1 AND strong_evidence = 1) AS malicious_with_strong_evidence,
 count(*) FILTER (WHERE attack_run = 1 AND label = 0 AND strong_evidence = 1) AS possible_fn,
 count(*) FILTER (WHERE attack_run = 1 AND label = 0 AND tier = 'DIRECT' AND strong_evidence = 0) AS weak_evidence_label0,
 count(*) FILTER (WHERE label = 1 AND tier = 'none' AND sandbox_ref = 0) AS lineage_only_malicious,
 count(*) FILTER (WHERE label = 1 AND attack_run = 0) AS label1_in_benign_runs,
 count(*) FILTER (WHERE parent_status = 'parent_not_logged') AS parent_not_logged FROM strong""", *_AUDITED))
def a21_summary(spark, sf):
    return audit.label_audit_summary(_audited(spark, sf))


@check("a21_audit_by_scenario", with_ev("""
SELECT platform, scenario, count(*) AS n, count(*) FILTER (WHERE label = 1) AS mal,
 count(*) FILTER (WHERE parent_status <> 'observed') AS not_logged,
 count(*) FILTER (WHERE attack_run = 1 AND label = 0 AND strong_evidence = 1) AS possible_fn,
 count(*) FILTER (WHERE label = 1 AND tier = 'none' AND sandbox_ref = 0) AS lineage_only
FROM strong GROUP BY ALL""", *_AUDITED))
def a21_scenario(spark, sf):
    return audit.label_audit_by_scenario(_audited(spark, sf))


def _sample(orders):
    verdict = F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "O", "Incorrect ").otherwise(
        "ambiguous")
    return orders.select(
        F.when(F.col("o_custkey") % 2 == 0, "windows").otherwise("linux").alias("platform"),
        F.col("o_orderpriority").alias("scenario"), (F.col("o_totalprice") > 150000).cast("int").alias("label"),
        verdict.alias("verdict"))


_WILSON = "(p + 3.8416 / (2 * n) {s} 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)"


@check("a22_audit_score", f"""
WITH s AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'windows' ELSE 'linux' END AS platform, o_orderpriority AS scenario,
    CAST(CAST(o_totalprice > 150000 AS INT) AS VARCHAR) AS label, o_orderstatus AS st FROM orders),
c AS (SELECT coalesce(platform, 'all') AS platform, coalesce(scenario, 'all') AS scenario,
    coalesce(label, 'all') AS label, count(*) AS checked, count(*) FILTER (WHERE st = 'F') AS correct,
    count(*) FILTER (WHERE st = 'O') AS incorrect, count(*) FILTER (WHERE st NOT IN ('F', 'O')) AS ambiguous
    FROM s GROUP BY GROUPING SETS ((), (platform, scenario, label))),
r AS (SELECT *, checked - ambiguous AS n, CAST(correct AS DOUBLE) / nullif(checked - ambiguous, 0) AS p FROM c)
SELECT platform, scenario, label, checked, correct, incorrect, ambiguous, round(p, 6) AS agreement,
       round({_WILSON.format(s='-')}, 6) AS ci95_low, round({_WILSON.format(s='+')}, 6) AS ci95_high FROM r""")
def a22(spark, sf):
    return rounded(metrics.audit_score(_sample(table(spark, sf, "orders"))))


@check("a23_dataset_inventory", with_ev(f"""
SELECT platform, computer, count(DISTINCT run_id) AS runs, count(*) AS events, {r6('avg(label)', 'label1')}
FROM ev GROUP BY ALL"""))
def a23(spark, sf):
    return rounded(audit.dataset_inventory(telemetry(spark, sf), ["platform", "computer"]))


def _impact(name, keys):
    return f"""SELECT '{name}' AS key, count(*) AS samples, count(*) FILTER (WHERE label = 1) AS malicious,
    count(*) FILTER (WHERE label = 0) AS benign, CAST((SELECT count(*) FROM ev) - sum(n) AS BIGINT) AS events_dropped,
    count(*) FILTER (WHERE runs > 1) AS keys_spanning_runs, count(*) FILTER (WHERE oses > 1) AS keys_spanning_platforms
    FROM (SELECT max(label) AS label, count(*) AS n, count(DISTINCT run_id) AS runs, count(DISTINCT platform) AS oses
          FROM (SELECT * REPLACE (substr(ProcessGuid, 4) AS ProcessGuid) FROM ev) GROUP BY {keys})"""


@check("a24_key_impact", with_ev(_impact("guid", "ProcessGuid") + " UNION ALL " + _impact("composite", KEY)))
def a24(spark, sf):
    e = telemetry(spark, sf)
    return audit.key_impact(e.withColumn("ProcessGuid", F.substring("ProcessGuid", 4, 100)))


@check("a25_dataset_summary", with_ev(f"""
SELECT platform, run_id, count(*) AS processes, count(*) FILTER (WHERE label = 1) AS malicious,
       count(DISTINCT lineage) AS lineages,
       count(*) FILTER (WHERE label = 0 AND session LIKE 'benign%') AS benign_in_benign_runs,
       count(*) FILTER (WHERE label = 0 AND session NOT LIKE 'benign%') AS benign_in_attack_runs
FROM (SELECT {KEY}, max(label) AS label, min(session) AS session, min(computer) AS lineage FROM ev GROUP BY {KEY})
GROUP BY ALL"""))
def a25(spark, sf):
    p = telemetry(spark, sf).groupBy(*PROCESS_KEY).agg(
        F.max("label").alias("label"), F.min("session").alias("session"), F.min("computer").alias("lineage"))
    return audit.dataset_summary(p)


@check("a26_length_sweep", """
SELECT t, round(avg(CASE WHEN (length(text) > t) = (toxic = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM documents JOIN labels USING (doc_id) CROSS JOIN (SELECT unnest(range(-1, 400, 5)) AS t) GROUP BY t""")
def a26(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.length("text").alias("n"), F.col("toxic").alias("label"))
    return rounded(metrics.length_sweep(d, "n")).withColumn("t", F.col("t").cast("long"))


@check("a27_mean_sd", f"""
SELECT o_orderpriority, {r6('avg(o_totalprice)', 'F1_mean')}, {r6('stddev_samp(o_totalprice)', 'F1_std')}
FROM orders GROUP BY 1""")
def a27(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_totalprice", "F1")
    return rounded(metrics.mean_sd(rows, ["o_orderpriority"], ["F1"]))


@check("a28_delta_between_variants", f"""
SELECT o_orderpriority, {r6("avg(v) FILTER (WHERE s = 'F')", 'F_F1')}, {r6("avg(v) FILTER (WHERE s = 'O')", 'O_F1')},
       {r6("avg(v) FILTER (WHERE s = 'O') - avg(v) FILTER (WHERE s = 'F')", 'F1_delta')}
FROM (SELECT o_orderpriority, o_orderstatus AS s, o_totalprice AS v FROM orders) GROUP BY 1""")
def a28(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_totalprice", "F1")
    return rounded(metrics.delta_between(rows, ["o_orderpriority"], "o_orderstatus", "F", "O", ["F1"]))


@check("a28_wins_over_baseline", """
SELECT m AS "Model", count(*) FILTER (WHERE v > base) AS wins, count(*) AS n FROM (
    SELECT o_orderpriority AS m, o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY ALL) JOIN (
    SELECT o_custkey, avg(o_totalprice) AS base FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    USING (o_custkey) WHERE m <> '1-URGENT' GROUP BY m""")
def a28_wins(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("Model"), "o_custkey").agg(
        F.avg("o_totalprice").alias("F1"))
    return metrics.wins_over_baseline(rows, ["o_custkey"], baseline="1-URGENT")


@check("a29_label_conflicts", with_ev(f"SELECT {KEY} FROM ev GROUP BY {KEY} HAVING count(DISTINCT label) > 1"))
def a29(spark, sf):
    return audit.label_conflicts(telemetry(spark, sf))


@check("a30_median_by_label", f"""
SELECT toxic, {r6('median(n_chars)', 'median')} FROM documents JOIN labels USING (doc_id) GROUP BY toxic""")
def a30(spark, sf):
    from hosttrace.operators.ordered import quantiles
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rounded(quantiles(d, ["toxic"], "n_chars", 0.5, "median"))


@check("a31_flagged_types", f"""
SELECT lang AS attack_type, count(*) AS n, {r6('avg(n_chars)', 'confidence')},
       {r6('count(*) / sum(count(*)) OVER ()', 'share')} FROM documents JOIN labels USING (doc_id)
WHERE toxic = 1 GROUP BY lang""")
def a31(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("lang").alias("attack_type"), F.col("toxic").alias("pred"), F.col("n_chars").alias("type_confidence"))
    return rounded(audit.flagged_types(d))


# --- cleaning -----------------------------------------------------------------------------------------------------

@check("p4_drop_repeats", """
SELECT min(o_orderkey) AS record_id, o_custkey, o_orderstatus FROM orders GROUP BY o_custkey, o_orderstatus""")
def p4(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey", "o_orderstatus")
    return clean.drop_repeats(rows)


@check("p2_p3_dash_and_empty_columns", """
SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang FROM documents""")
def p3(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", "-").otherwise(F.col("lang")).alias("lang"), F.lit("-").alias("void"))
    return clean.drop_empty_columns(clean.dash_to_null(d))


@check("p6_unkeyed_count", with_ev(
    "SELECT count(*) AS events, count(ParentProcessGuid) AS kept, count(*) - count(ParentProcessGuid) AS dropped FROM ev"))
def p6(spark, sf):
    e = telemetry(spark, sf)
    return clean.unkeyed_count(e.withColumn("ProcessGuid", F.col("ParentProcessGuid")))


@check("p7_process_keys", with_ev(f"""
SELECT record_id, {NODE} AS pkey, platform || '|' || run_id || '|' || ParentProcessGuid AS parent_pkey FROM ev"""))
def p7(spark, sf):
    return clean.with_keys(telemetry(spark, sf)).select("record_id", "pkey", "parent_pkey")


@check("p8_runs_matching", with_ev(
    "SELECT record_id, run_id FROM ev WHERE contains(session, 'win') AND NOT contains(session, 'miner')"))
def p8(spark, sf):
    return clean.runs_matching(telemetry(spark, sf), ["win"], ["miner"], "session").select("record_id", "run_id")


_TABLES = ["events", "orders", "lineitem", "customer", "supplier", "part", "documents", "embeddings", "labels"]


@check("p9_schema_differences", f"""WITH c AS (SELECT table_name AS name, column_name AS col FROM duckdb_columns()
    WHERE table_name IN ({', '.join(f"'{t}'" for t in _TABLES)})), h AS (SELECT col FROM c WHERE name = 'events'),
n AS (SELECT DISTINCT name FROM c WHERE name <> 'events'),
missing AS (SELECT name, col FROM n CROSS JOIN h EXCEPT SELECT name, col FROM c),
extra AS (SELECT name, col FROM c WHERE name <> 'events' AND col NOT IN (SELECT col FROM h))
SELECT name, coalesce(m, '') AS missing, coalesce(e, '') AS extra FROM n
LEFT JOIN (SELECT name, string_agg(col, ',' ORDER BY col) AS m FROM missing GROUP BY 1) USING (name)
LEFT JOIN (SELECT name, string_agg(col, ',' ORDER BY col) AS e FROM extra GROUP BY 1) USING (name)
WHERE m IS NOT NULL OR e IS NOT NULL""")
def p9(spark, sf):
    """What each given table lacks or adds against the first; only schemas are read."""
    found = clean.schema_differences({t: table(spark, sf, t) for t in _TABLES})
    return spark.createDataFrame([(n, ",".join(m), ",".join(e)) for n, m, e in found], "name string, missing string, extra string")


_RULES = {
    "platform_unknown": "status NOT IN ('linux', 'windows')", "run_id_empty": "trim(run) = ''",
    "run_id_has_separator": "contains(run, '|')", "event_id_not_integer": "TRY_CAST(eid AS INT) IS NULL",
    "event_id_unknown": "TRY_CAST(eid AS INT) NOT IN (1, 2, 3, 4, 5, 8, 9, 11, 12, 13, 23)",
    "label_outside_0_1": "label NOT IN (0, 1)",
}


@check("p10_input_violations", """WITH c AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'linux' ELSE 'mac' END AS status,
    CASE WHEN l_linestatus = 'O' THEN '' ELSE 'a|b' END AS run, CAST(l_linenumber AS VARCHAR) ||
    CASE WHEN l_quantity > 40 THEN 'x' ELSE '' END AS eid, CAST(l_linenumber % 3 AS INT) AS label FROM lineitem) """
       + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {w}) AS violations FROM c"
                            for n, w in _RULES.items()))
def p10(spark, sf):
    c = F.col
    rows = table(spark, sf, "lineitem").select(
        F.when(c("l_returnflag") == "A", "linux").otherwise("mac").alias("platform"),
        F.when(c("l_linestatus") == "O", "").otherwise("a|b").alias("run_id"),
        F.concat(c("l_linenumber").cast("string"), F.when(c("l_quantity") > 40, "x").otherwise("")).alias("EventID"),
        (c("l_linenumber") % 3).alias("label"))
    return clean.input_violations(rows)


@check("p11_detect_platform", with_ev("""
SELECT *, CASE WHEN windows_evidence >= linux_evidence THEN 'windows' ELSE 'linux' END AS platform,
       least(windows_evidence, linux_evidence) > 0.05 * greatest(windows_evidence, linux_evidence) AS ambiguous
FROM (SELECT count(*) FILTER (WHERE regexp_matches(Image, '^[A-Za-z]:\\\\')) + count(*) FILTER (WHERE
      regexp_matches(TargetFilename, '^[A-Za-z]:\\\\')) + count(*) FILTER (WHERE regexp_matches(CurrentDirectory,
      '^[A-Za-z]:\\\\')) + count(*) FILTER (WHERE contains("User", '\\')) + count(*) FILTER (WHERE EventID IN
      (2, 6, 7, 8, 10, 12, 13, 14, 15, 17, 18, 19, 20, 21, 22, 24, 25, 26)) AS windows_evidence,
      count(*) FILTER (WHERE starts_with(Image, '/')) + count(*) FILTER (WHERE starts_with(TargetFilename, '/'))
      + count(*) FILTER (WHERE starts_with(CurrentDirectory, '/')) AS linux_evidence FROM ev)"""))
def p11(spark, sf):
    return clean.detect_platform(telemetry(spark, sf))


@check("p12_dead_features", "SELECT 'CommandLine' AS source, 'cmd_len' AS feature UNION ALL SELECT 'ParentCommandLine', "
       "'pcmd_len' UNION ALL SELECT 'Device', 'n_device' FROM (SELECT count(*) FROM events)")
def p12(spark, sf):
    lost = telemetry(spark, sf).drop("CommandLine").withColumns(
        {"Device": F.lit(None).cast("string"), "ParentCommandLine": F.lit(None).cast("string")})
    return clean.dead_features(lost)


_FIT = [c for c in _REPORTED if c not in {*DROP_BEFORE_FIT, *DERIVED_DROP, *LEAKY_COLS}]


@check("p5_leak_free_columns", with_ev(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(*) AS total FROM ev" for c in _FIT)))
def p5(spark, sf):
    return clean.column_fill(clean.leak_free(telemetry(spark, sf), DROP_BEFORE_FIT, DERIVED_DROP, LEAKY_COLS))


@check("p18_replay_order", with_ev("SELECT record_id, row_number() OVER (ORDER BY UtcTime, record_id) AS position FROM ev"))
def p18(spark, sf):
    return relations.positions(telemetry(spark, sf), [F.col(c) for c in clean.REPLAY]).select("record_id", "position")


@check("m1_encoder", with_ev("""
SELECT record_id, CAST(coalesce(length(CommandLine), -1) AS DOUBLE) AS cmd, CAST(code AS DOUBLE) AS img,
       CAST(coalesce(SourcePort, -1) AS DOUBLE) AS port FROM ev JOIN cats USING (Image)""",
    "cats AS (SELECT Image, row_number() OVER (ORDER BY Image) - 1 AS code FROM (SELECT DISTINCT Image FROM ev))"))
def m1(spark, sf):
    e = telemetry(spark, sf).select("record_id", F.col("Image").alias("img"), F.col("CommandLine").alias("cmd"),
                                    F.col("SourcePort").alias("port"))
    return encode.EventEncoder(limit=15).fit(e.drop("record_id")).transform(e, keep=["record_id"])


@check("m2_first_seen_codes", with_ev("""
SELECT record_id, CAST(code AS DOUBLE) AS img FROM ev JOIN cats USING (Image)""",
    "cats AS (SELECT Image, row_number() OVER (ORDER BY min(record_id)) - 1 AS code FROM ev GROUP BY Image)"))
def m2(spark, sf):
    e = telemetry(spark, sf).select("record_id", F.col("Image").alias("img"), F.col("record_id").alias("_seq"))
    enc = encode.EventEncoder().fit(e.drop("record_id"), first_seen_by="_seq")
    return enc.transform(e, keep=["record_id"])


@check("m3_constant_columns", with_ev(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min({c}) = max({c}) AS constant FROM feats" for c in PROCESS_FEATURES),
    f"feats AS ({_features_sql(KEY, 'ev', ', label')})"))
def m3(spark, sf):
    return encode.column_spread(process_features(telemetry(spark, sf)), PROCESS_FEATURES)


@check("m4_standardise", f"""
SELECT o_orderkey, {r6('(o_totalprice - m) / s', 'o_totalprice')} FROM orders, (
    SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F')""")
def m4(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    scaled, = encode.standardise(o.where("o_orderstatus = 'F'"), [o.drop("o_orderstatus")], ["o_totalprice"])
    return rounded(scaled)
