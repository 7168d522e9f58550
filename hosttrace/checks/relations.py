"""Enrichment, process forests and labelling."""

from pyspark.sql import functions as F

from hosttrace.checks.features import _features_sql
from hosttrace.checks.registry import KEY, NODE, PARENT, check, rounded, with_ev
from hosttrace.checks.telemetry import table, telemetry, telemetry_table
from hosttrace.functions.rules import AGENT_IMAGE, PLAN_COMMAND, PLAN_IMAGE, SCRIPT_HOSTS
from hosttrace.operators import audit, clean, enrich, features, graph, label, relations, splits
from hosttrace.schema import INHERIT_COLS, PROCESS_KEY

_INHERIT = [c for c in INHERIT_COLS if c in ("CommandLine", "CurrentDirectory", "ParentProcessGuid",
                                             "ParentProcessId", "ParentImage", "ParentCommandLine")]


def _entries(key, name):
    last = f"SELECT *, row_number() OVER (PARTITION BY platform, run_id, {key} ORDER BY record_id DESC) AS rn FROM ev " \
           f"WHERE EventID = 1"
    return f"{name} AS (SELECT * EXCLUDE (rn) FROM ({last}) WHERE rn = 1)"


def _enriched(pid):
    entry = {c: f"CASE WHEN g.record_id IS NOT NULL THEN g.{c} {f'ELSE p.{c}' if pid else ''} END" for c in _INHERIT}
    gain = " OR ".join(f"(e.{c} IS NULL AND {x} IS NOT NULL)" for c, x in entry.items())
    method = "CASE WHEN g.record_id IS NOT NULL THEN 'guid' " + (
        "WHEN p.record_id IS NOT NULL THEN 'pid' " if pid else "") + "END"
    join_pid = ("LEFT JOIN by_pid p ON p.platform = e.platform AND p.run_id = e.run_id AND p.ProcessId = e.ProcessId"
                if pid else "")
    cols = ", ".join(f"coalesce(e.{c}, {x}) AS {c}" for c, x in entry.items())
    return f"""enriched AS (SELECT e.record_id, e.EventID, e.UtcTime, e.platform, e.run_id, e.ProcessGuid, e.Image,
    e.label, e.TargetFilename, e.DestinationIp, e.DestinationPort, e.TargetObject, e.Device, {cols},
    CASE WHEN e.EventID <> 1 AND ({gain}) THEN 1 ELSE 0 END AS enriched,
    CASE WHEN e.EventID <> 1 AND ({gain}) THEN {method} ELSE 'none' END AS enrich_method
    FROM ev e LEFT JOIN by_guid g ON g.platform = e.platform AND g.run_id = e.run_id
    AND g.ProcessGuid = e.ProcessGuid {join_pid})"""


_COLS = ["record_id", *_INHERIT, "enriched", "enrich_method"]


@check("j2_enrich_with_pid_fallback", with_ev(f"SELECT {', '.join(_COLS)} FROM enriched",
                                              _entries("ProcessGuid", "by_guid"), _entries("ProcessId", "by_pid"),
                                              _enriched(True)))
def j2(spark, sf):
    return enrich.enrich(telemetry_table(spark, sf)).select(*_COLS)


@check("j1_enrich_from_process_table", with_ev(f"SELECT {', '.join(_COLS)} FROM enriched",
                                               _entries("ProcessGuid", "by_guid"), _enriched(False)))
def j1(spark, sf):
    return enrich.enrich(telemetry_table(spark, sf), pid_fallback=False).select(*_COLS)


@check("a10_fill_gain", with_ev(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (SELECT count({c}) FROM ev) AS before, count({c}) AS after, count(*) AS total, "
    f"count({c}) > (SELECT count({c}) FROM ev) AS gained FROM enriched" for c in _INHERIT),
    _entries("ProcessGuid", "by_guid"), _entries("ProcessId", "by_pid"), _enriched(True)))
def a10_gain(spark, sf):
    before = telemetry_table(spark, sf)
    return audit.fill_gain(before, enrich.enrich(before), _INHERIT)


# --- forests ------------------------------------------------------------------------------------------------------

_CREATED = f"""created AS (SELECT {NODE} AS node, {PARENT} AS parent, Image AS image, ParentImage AS pimage
    FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY record_id DESC) AS rn FROM ev WHERE EventID = 1)
    WHERE rn = 1)"""
# Every chain walked upwards from its start; the forest of the given tables has no cycles.
_UP = """up AS (SELECT node AS start, node, 0 AS dist FROM created UNION ALL
    SELECT up.start, c2.node, up.dist + 1 FROM up JOIN created c ON c.node = up.node
    JOIN created c2 ON c2.node = c.parent)"""
_TOP = "tops AS (SELECT start AS node, arg_max(node, dist) AS root, max(dist) AS dist FROM up GROUP BY start)"


@check("g1_depth_and_root_image", with_ev("""
SELECT t.node, CAST(least(t.dist + CASE WHEN r.parent IS NOT NULL THEN 1 ELSE 0 END, 20) AS INT) AS ancestor_depth,
       r.image AS root_image FROM tops t JOIN created r ON r.node = t.root""", _CREATED, _UP, _TOP))
def g1(spark, sf):
    return graph.depth_and_root_image(enrich.creation_forest(telemetry_table(spark, sf)))


_PROCS = f"""procs AS (SELECT {NODE} AS node, max(label) AS label, arg_min(Image, record_id) AS image,
    CASE WHEN count(ParentProcessGuid) > 0 THEN platform || '|' || run_id || '|' || arg_min(ParentProcessGuid, record_id)
    FILTER (WHERE ParentProcessGuid IS NOT NULL) END AS parent FROM ev GROUP BY {KEY})"""
_PROC_UP = _UP.replace("created", "procs")


def _processes(spark, sf):
    meta = features.process_meta(telemetry_table(spark, sf))
    return meta.withColumns({"node": clean.process_key(), "parent": clean.process_key("ParentProcessGuid")})


@check("g5_lineage_root", with_ev("SELECT node, root, dist FROM tops", _PROCS, _PROC_UP, _TOP))
def g5(spark, sf):
    return graph.topmost(_processes(spark, sf))


@check("g6_ancestor_chain", with_ev("""
SELECT start AS node, string_agg(regexp_extract(image, '([^\\\\/]*)$', 1), ' < ' ORDER BY dist) AS lineage_chain
FROM up JOIN procs USING (node) WHERE dist < 12 GROUP BY start""", _PROCS, _PROC_UP))
def g6(spark, sf):
    return graph.chain_text(_processes(spark, sf))


@check("g10_parent_status", with_ev("""
SELECT p.node, CASE WHEN p.parent IS NULL THEN 'no_parent_info' WHEN q.node IS NOT NULL THEN 'observed'
       ELSE 'parent_not_logged' END AS parent_status FROM procs p LEFT JOIN procs q ON q.node = p.parent""", _PROCS))
def g10(spark, sf):
    return graph.parent_status(_processes(spark, sf)).select("node", "parent_status")


# --- labels -------------------------------------------------------------------------------------------------------

_EDGES = f"""by_pid AS (SELECT platform, run_id, ProcessId AS ParentProcessId, arg_max(ProcessGuid, record_id) AS owner
    FROM ev GROUP BY ALL), edges AS (
    SELECT DISTINCT {NODE} AS child, {PARENT} AS parent FROM ev WHERE EventID = 1 AND ParentProcessGuid IS NOT NULL
    UNION SELECT {NODE}, platform || '|' || run_id || '|' || owner FROM ev JOIN by_pid
    USING (platform, run_id, ParentProcessId) WHERE EventID = 1)"""
_GUID_EDGES = f"edges AS (SELECT DISTINCT {NODE} AS child, {PARENT} AS parent FROM ev WHERE EventID = 1 " \
              "AND ParentProcessGuid IS NOT NULL)"
_CLOSURE = "reached AS (SELECT node FROM seeds UNION SELECT child FROM reached JOIN edges ON parent = node)"
_SEEDS = f"""seeds AS (SELECT DISTINCT {NODE} AS node FROM ev WHERE contains(Image, '/tmp/payload')
    OR contains(lower(CommandLine), 'schtasks') OR starts_with(CurrentDirectory, '/tmp/lab_sandbox'))"""
_LABELLED = f"""SELECT record_id, CASE WHEN {NODE} IN (SELECT node FROM reached) THEN 1 ELSE 0 END AS label,
    '%s' AS label_method, CASE WHEN {NODE} IN (SELECT node FROM seeds) THEN 1 ELSE 0 END AS is_seed FROM ev"""
_LABEL_COLS = ["record_id", "label", "label_method", "is_seed"]


@check("g2_label_by_lineage", with_ev(_LABELLED % "lineage", _SEEDS, _EDGES, _CLOSURE))
def g2(spark, sf):
    return label.label_by_lineage(telemetry_table(spark, sf), images=["/tmp/payload"], commands=["SchTasks"],
                                  dirs=["/tmp/lab_sandbox"]).select(*_LABEL_COLS)


_SUSPECT = "(starts_with(Image, '/tmp/') OR starts_with(Image, '/dev/shm/') OR starts_with(Image, '/var/tmp/') " \
           "OR starts_with(Image, '/run/user/'))"


@check("j7_unseen_images", with_ev(
    f"SELECT record_id FROM ev WHERE {_SUSPECT} AND Image NOT IN (SELECT Image FROM ev WHERE Device = 'disk1' "
    "AND platform = 'windows')"))
def j7(spark, sf):
    e = telemetry_table(spark, sf)
    return label.unseen_images(e, e.where("Device = 'disk1' AND platform = 'windows'")).select("record_id")


@check("g3_label_by_baseline", with_ev(f"""
SELECT record_id, CASE WHEN label = 1 OR {NODE} IN (SELECT node FROM reached) THEN 1 ELSE 0 END AS label,
       CASE WHEN label <> 1 AND {NODE} IN (SELECT node FROM reached) THEN 'baseline' END AS label_method FROM ev""",
    f"""seeds AS (SELECT DISTINCT {NODE} AS node FROM ev WHERE label = 1 OR ({_SUSPECT}
    AND Image NOT IN (SELECT Image FROM ev WHERE platform = 'windows')))""", _EDGES, _CLOSURE))
def g3(spark, sf):
    e = telemetry_table(spark, sf)
    return label.label_by_baseline(e, e.where("platform = 'windows'")).select("record_id", "label", "label_method")


@check("g4_label_session", with_ev(
    "SELECT record_id, 1 AS label, 'session' AS label_method, CAST(NULL AS INT) AS is_seed FROM ev"))
def g4(spark, sf):
    return label.label_session(telemetry(spark, sf), 1).select(*_LABEL_COLS)


@check("g7_sample_lineage", with_ev(
    "SELECT node FROM reached",
    f"seeds AS (SELECT DISTINCT {NODE} AS node FROM ev WHERE regexp_matches(Image, '^/tmp/[^/]+$'))", _GUID_EDGES,
    _CLOSURE))
def g7(spark, sf):
    return label.sample_lineage(telemetry_table(spark, sf))


@check("g8_label_by_plan", with_ev(_LABELLED % "plan", f"""seeds AS (SELECT DISTINCT {NODE} AS node FROM ev
    WHERE regexp_matches(lower(Image), '{PLAN_IMAGE}') OR regexp_matches(lower(CommandLine), '{PLAN_COMMAND}')
    OR (ends_with(lower(Image), 'powershell.exe') AND (ends_with(lower(ParentImage), '\\control.exe')
        OR ends_with(lower(ParentImage), '\\wmiprvse.exe'))))""", _GUID_EDGES, _CLOSURE))
def g8(spark, sf):
    return label.label_by_plan(telemetry_table(spark, sf)).select(*_LABEL_COLS)


_SHELL = " OR ".join(f"ends_with(lower(f.pimage), '{s}')" for s in SCRIPT_HOSTS)


@check("g9_lineage_status", with_ev(f"""
SELECT record_id, CAST(status AS INT) AS label FROM (
    SELECT record_id, CASE WHEN {NODE} IN (SELECT node FROM reached) THEN 1 WHEN t.node IS NULL THEN -1
        WHEN f.pimage IS NULL OR {_SHELL} THEN -1 ELSE 0 END AS status
    FROM ev LEFT JOIN tops t ON t.node = {NODE} LEFT JOIN created f ON f.node = t.root) WHERE status >= 0""",
    f"""seeds AS (SELECT {NODE} AS node FROM ev WHERE regexp_matches(lower(Image), '{AGENT_IMAGE}')
    UNION SELECT {PARENT} FROM ev WHERE regexp_matches(lower(ParentImage), '{AGENT_IMAGE}'))""",
    _CREATED.replace("record_id DESC", "record_id"), _UP, _TOP, _GUID_EDGES, _CLOSURE))
def g9(spark, sf):
    return label.label_by_agent(telemetry_table(spark, sf)).select("record_id", "label")


@check("a15_perfect_predictors", """
WITH c AS (SELECT unnest(['o_orderstatus', 'o_orderpriority', 'flag', 'o_custkey']) AS "column",
                  unnest([o_orderstatus, o_orderpriority, flag, CAST(o_custkey AS VARCHAR)]) AS value, label
           FROM (SELECT *, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS label,
                        CASE WHEN o_totalprice > 150000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END
                        AS flag FROM orders))
SELECT "column", count(*) AS n_values, false AS leaky FROM (
    SELECT "column", value, count(DISTINCT label) AS k FROM c WHERE value <> '' GROUP BY ALL)
GROUP BY "column" HAVING count(*) <= 200 AND max(k) = 1""")
def a15(spark, sf):
    price = F.col("o_totalprice")
    orders = table(spark, sf, "orders").select(
        "o_orderstatus", "o_orderpriority", "o_custkey", F.when(price > 150000, 1).otherwise(0).alias("label"),
        F.when(price > 150000, "big").when(price > 50000, "mid").otherwise("small").alias("flag"))
    return label.perfect_predictors(orders)


# --- other joins and set operations -------------------------------------------------------------------------------

@check("j10_membership", with_ev(f"""
SELECT record_id, {NODE} IN (SELECT {NODE} FROM ev WHERE label = 1) AS seen FROM ev"""))
def j10(spark, sf):
    e = telemetry_table(spark, sf).withColumn("node", clean.process_key())
    return relations.membership(e, e.where("label = 1"), "node").select("record_id", "seen")


@check("j11_run_repetition", with_ev("""
SELECT record_id, rep FROM ev JOIN (
    SELECT platform, run_id, row_number() OVER (PARTITION BY platform, session ORDER BY min(UtcTime), run_id) AS rep
    FROM ev GROUP BY platform, session, run_id) USING (platform, run_id)"""))
def j11(spark, sf):
    e = telemetry_table(spark, sf)
    runs = e.groupBy("platform", "session", "run_id").agg(F.min("UtcTime").alias("start"))
    numbered = splits.repetition_numbers(runs).select("platform", "run_id", F.col("rep").cast("long").alias("rep"))
    return e.join(numbered, ["platform", "run_id"]).select("record_id", "rep")


@check("w1_repetition_numbers", with_ev("""
SELECT platform, session, run_id, row_number() OVER (PARTITION BY platform, session ORDER BY min(UtcTime), run_id) AS rep
FROM ev GROUP BY platform, session, run_id"""))
def w1(spark, sf):
    runs = telemetry(spark, sf).groupBy("platform", "session", "run_id").agg(F.min("UtcTime").alias("start"))
    return splits.repetition_numbers(runs).select("platform", "session", "run_id", F.col("rep").cast("long").alias("rep"))


@check("j12_outer_join_of_summaries", with_ev("""
SELECT ProcessId, a.n AS created, b.n AS connected FROM
    (SELECT ProcessId, count(*) AS n FROM ev WHERE EventID = 1 AND platform = 'linux' GROUP BY 1) a FULL JOIN
    (SELECT ProcessId, count(*) AS n FROM ev WHERE EventID = 3 AND platform = 'windows' GROUP BY 1) b USING (ProcessId)"""))
def j12(spark, sf):
    e, n = telemetry(spark, sf), F.count(F.lit(1))
    created = e.where("EventID = 1 AND platform = 'linux'").groupBy("ProcessId").agg(n.alias("created"))
    connected = e.where("EventID = 3 AND platform = 'windows'").groupBy("ProcessId").agg(n.alias("connected"))
    return relations.side_by_side([created, connected], "ProcessId")


@check("j13_first_event_per_process", with_ev(f"""
SELECT {KEY}, arg_min(Image, record_id) AS Image, arg_min(EventID, record_id) AS EventID, min(record_id) AS record_id
FROM ev GROUP BY {KEY}"""))
def j13(spark, sf):
    return relations.first_rows(telemetry_table(spark, sf), PROCESS_KEY, ["Image", "EventID"])


_FIXED = "SELECT * REPLACE (1 AS label) FROM ev WHERE platform = 'windows'"


@check("j14_substitute_runs", with_ev(
    f"SELECT record_id, platform, label FROM (SELECT * FROM ev WHERE platform <> 'windows' UNION ALL {_FIXED})"))
def j14(spark, sf):
    e = telemetry_table(spark, sf)
    fixed = e.where("platform = 'windows'").withColumn("label", F.lit(1))
    return clean.substitute_runs(e, fixed)[0].select("record_id", "platform", "label")


@check("u1_union_of_runs", with_ev("""
SELECT platform, part, count(*) AS events, count(DISTINCT run_id) AS runs FROM (
    SELECT platform, run_id, 'a' AS part FROM ev WHERE EventID = 1
    UNION ALL SELECT platform, run_id, 'b' FROM ev WHERE EventID <> 1) GROUP BY ALL"""))
def u1(spark, sf):
    e = telemetry(spark, sf).select("platform", "run_id", "EventID")
    parts = clean.union_runs([e.where("EventID = 1").withColumn("part", F.lit("a")),
                              e.where("EventID <> 1").withColumn("part", F.lit("b"))])
    return parts.groupBy("platform", "part").agg(F.count(F.lit(1)).alias("events"),
                                                 F.count_distinct("run_id").alias("runs"))


_SIDE = "SELECT DISTINCT ProcessGuid FROM ev WHERE %s"


@check("u2_except", with_ev(f"{_SIDE % 'EventID = 1'} EXCEPT {_SIDE % 'label = 1'}"))
def u2(spark, sf):
    e = telemetry(spark, sf)
    return relations.only_in_first(e.where("EventID = 1"), e.where("label = 1"), ["ProcessGuid"])


@check("u3_intersect", with_ev("SELECT DISTINCT DestinationIp FROM ev WHERE platform = 'linux' INTERSECT "
                               "SELECT DISTINCT DestinationIp FROM ev WHERE platform = 'windows'"))
def u3(spark, sf):
    e = telemetry(spark, sf)
    return relations.in_both(e.where("platform = 'linux'"), e.where("platform = 'windows'"), ["DestinationIp"])


@check("u4_one_sided_event_ids", with_ev("""
SELECT EventID, count(*) FILTER (WHERE platform = 'linux') AS linux,
       count(*) FILTER (WHERE platform = 'windows') AS windows FROM ev GROUP BY EventID
HAVING (count(*) FILTER (WHERE platform = 'linux') = 0) <> (count(*) FILTER (WHERE platform = 'windows') = 0)"""))
def u4(spark, sf):
    return audit.one_sided_events(telemetry(spark, sf), "linux", "windows")


_WITH_DEPTH = """deep AS (SELECT e.*, CASE WHEN t.dist IS NOT NULL THEN
          CAST(least(t.dist + CASE WHEN r.parent IS NOT NULL THEN 1 ELSE 0 END, 20) AS INT) END AS depth
      FROM enriched e LEFT JOIN tops t ON t.node = e.platform || '|' || e.run_id || '|' || e.ProcessGuid
      LEFT JOIN created r ON r.node = t.root)"""


@check("a2_guid_only_features", with_ev(_features_sql(
    "ProcessGuid", "deep", ", label, n_runs, coalesce(img_len, 0) AS img_len, coalesce(depth, 0) AS depth, enriched",
    "max(label) AS label, count(DISTINCT run_id) AS n_runs, arg_min(length(Image), record_id) AS img_len, max(depth) AS depth, "
    "max(enriched) AS enriched"), _entries("ProcessGuid", "by_guid"), _entries("ProcessId", "by_pid"), _enriched(True), _CREATED,
    _UP, _TOP, _WITH_DEPTH))
def a2(spark, sf):
    return rounded(features.guid_only_features(enrich.add_lineage(enrich.enrich(telemetry_table(spark, sf)))))
