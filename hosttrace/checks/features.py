"""Process features, prefixes, siblings, evidence."""

from pyspark.sql import functions as F

from hosttrace.checks.registry import EV, KEY, NODE, PARENT, check, r6, rounded, with_ev
from hosttrace.checks.telemetry import payload_sql, telemetry, telemetry_table
from hosttrace.functions.rules import EVIDENCE_TESTS, TACTICS, TACTIC_NAMES, severity, technique_of, with_evidence
from hosttrace.functions.text import PRIVATE_IP, SENSITIVE
from hosttrace.operators import features
from hosttrace.operators.clean import truth_known
from hosttrace.schema import FEATURE_EVENT_IDS, PROCESS_KEY

_DISTINCT = ", ".join(f"count(DISTINCT {c}) AS {n}" for n, c in features.DISTINCT.items())
_FIRST = ", ".join(f"arg_min(length({c}), record_id) FILTER (WHERE {c} IS NOT NULL) AS {n}"
                   for n, c in (("cmd_len", "CommandLine"), ("pcmd_len", "ParentCommandLine")))
_DUR = "(epoch_us(max(UtcTime)) - epoch_us(min(UtcTime))) / 1e6 AS dur_s"
_EVS = ", ".join(f"count(*) FILTER (WHERE EventID = {e}) AS ev_{e}" for e in FEATURE_EVENT_IDS)


def _features_sql(keys, source, tail="", extra="max(label) AS label"):
    """The 32 features from grouped rows of ``source``."""
    lens = ", ".join(r6(f"coalesce({c}, 0)", c) for c in ("cmd_len", "pcmd_len"))
    out = ", ".join([f"CAST(n_events AS DOUBLE) AS n_events"]
                    + [f"CAST(ev_{e} AS DOUBLE) AS ev_{e}" for e in FEATURE_EVENT_IDS]
                    + [r6(f"ev_{e} / n_events", f"frac_{e}") for e in FEATURE_EVENT_IDS]
                    + [f"CAST({n} AS DOUBLE) AS {n}" for n in features.DISTINCT]
                    + [r6("coalesce(dur_s, 0)", "dur_s"), r6("n_events / greatest(coalesce(dur_s, 0), 1)", "rate"),
                       lens])
    return f"""
SELECT {keys}, {out}{tail}
FROM (SELECT {keys}, count(*) AS n_events, {_EVS}, {_DISTINCT}, {_DUR}, {_FIRST}, {extra} FROM {source}
      GROUP BY {keys})"""


@check("a1_process_features", with_ev(_features_sql(KEY, "ev", ", label")))
def a1(spark, sf):
    return rounded(features.process_features(telemetry(spark, sf)))


@check("a3_vocabulary_features", with_ev(f"""
SELECT {KEY}, n_events, {', '.join(f'ev_{e}, ' + r6(f'ev_{e} / n_events', f'frac_{e}') for e in (1, 3, 5, 11, 13, 23))}
FROM (SELECT {KEY}, count(*) AS n_events, {_EVS} FROM ev GROUP BY {KEY})"""))
def a3(spark, sf):
    return rounded(features.vocabulary_features(telemetry(spark, sf)))


_AGES = "ages AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {a if a != float('inf') else 1e12})" for i, a in enumerate(features.AGES)) + ") AS t(age_ix, age))"
_AGED = f"""aged AS (SELECT ev.*, s.start, (epoch_us(UtcTime) - epoch_us(start)) / 1e6 AS since
    FROM ev JOIN (SELECT {KEY}, min(UtcTime) AS start FROM ev GROUP BY {KEY}) s USING ({KEY}))"""
_PREFIX = "prefix AS (SELECT aged.*, age_ix, age FROM aged JOIN ages ON since <= age)"
_UNWRAPPED = f"""unwrapped AS (SELECT * REPLACE ({payload_sql('CommandLine')} AS CommandLine,
    {payload_sql('ParentCommandLine')} AS ParentCommandLine) FROM prefix)"""


@check("a4_prefix_features", with_ev(_features_sql(KEY + ", age_ix", "unwrapped"), _AGES, _AGED, _PREFIX, _UNWRAPPED))
def a4(spark, sf):
    return rounded(features.prefix_features(telemetry_table(spark, sf), behaviour=False))


def _entropy_sql(c):
    chars = f"list_distinct(string_split({c}, ''))"
    share = f"((length({c}) - length(replace({c}, ch, ''))) / length({c}))"
    return (f"CASE WHEN length({c}) > 0 THEN list_sum(list_transform({chars}, lambda ch: "
            f"-{share} * log2({share}))) ELSE 0.0 END")


def quoted(pattern):
    return "'" + pattern.replace("'", "''") + "'"


_NAME = "regexp_extract(TargetFilename, '([^\\\\/]*)$', 1)"
_EXT = f"nullif(lower(regexp_extract({_NAME}, '\\.([A-Za-z0-9]{{1,8}})$', 1)), '')"


@check("a5_behaviour_at_age", with_ev(f"""
SELECT {KEY}, age_ix,
       count(*) FILTER (WHERE regexp_matches(coalesce(TargetFilename, ''), {quoted(SENSITIVE)})
                        OR regexp_matches(coalesce(TargetObject, ''), {quoted(SENSITIVE)})) AS b_sensitive,
       {r6("coalesce(avg(ent), 0)", "b_fname_ent_mean")}, {r6("coalesce(max(ent), 0)", "b_fname_ent_max")},
       count(DISTINCT ext) AS b_n_ext,
       count(*) FILTER (WHERE EventID = 3 AND NOT regexp_matches(DestinationIp, {quoted(PRIVATE_IP)})) AS b_ext_conn,
       CAST(coalesce(max(churn), 0) AS BIGINT) AS b_create_then_delete,
       CAST(coalesce(max(kids), 0) AS BIGINT) AS b_children
FROM (SELECT prefix.*, CASE WHEN EventID = 11 THEN {_entropy_sql("last")} END AS ent,
             CASE WHEN EventID = 11 THEN ext0 END AS ext
      FROM (SELECT *, {_NAME} AS last, {_EXT} AS ext0 FROM prefix) AS prefix) AS p
LEFT JOIN (SELECT {KEY}, age_ix, count(*) AS churn FROM (
               SELECT {KEY}, age_ix, lower(TargetFilename) AS path FROM prefix WHERE EventID IN (11, 23)
               GROUP BY ALL HAVING count(DISTINCT EventID) = 2) GROUP BY ALL) USING ({KEY}, age_ix)
LEFT JOIN (SELECT platform, run_id, c.ParentProcessGuid AS ProcessGuid, age_ix, count(*) AS kids
           FROM ev c JOIN (SELECT {KEY}, min(UtcTime) AS start FROM ev GROUP BY {KEY}) s
                USING (platform, run_id) JOIN ages ON (epoch_us(c.UtcTime) - epoch_us(s.start)) / 1e6 <= age
           WHERE c.EventID = 1 AND c.ParentProcessGuid = s.ProcessGuid GROUP BY ALL) USING ({KEY}, age_ix)
GROUP BY {KEY}, age_ix""", _AGES, _AGED, _PREFIX))
def a5(spark, sf):
    rows = features.prefix_features(telemetry_table(spark, sf))
    return rounded(rows.select(*PROCESS_KEY, "age_ix", "b_sensitive", "b_fname_ent_mean", "b_fname_ent_max", "b_n_ext",
                               "b_ext_conn", "b_create_then_delete", "b_children"))


@check("a6_sibling_context", with_ev(f"""
SELECT platform, run_id, p.ProcessGuid, age_ix, count(*) AS b_sib_spawned,
       count(*) FILTER (WHERE s.img = p.img) AS b_sib_same_image, count(DISTINCT s.img) AS b_sib_images
FROM procs p JOIN procs s USING (platform, run_id, parent) JOIN ages ON s.at <= p.at + age
GROUP BY ALL""", _AGES.replace("1000000000000.0", "10000000.0"), f"""procs AS (SELECT {KEY},
    arg_min(ParentProcessGuid, record_id) FILTER (WHERE ParentProcessGuid IS NOT NULL) AS parent,
    lower(regexp_extract(arg_min(Image, record_id), '([^\\\\/]*)$', 1)) AS img, epoch_us(min(UtcTime)) / 1e6 AS at
    FROM ev GROUP BY {KEY} HAVING parent IS NOT NULL)"""))
def a6(spark, sf):
    meta = features.process_meta(telemetry_table(spark, sf))
    return features.sibling_context(meta).drop("b_sib_period_cv", "b_sib_period_s")


@check("a6_sibling_periods", with_ev(f"""
SELECT {KEY}, age_ix, {r6("CASE WHEN n < 3 THEN -1 WHEN mean > 0 THEN sd / mean ELSE 0 END", "b_sib_period_cv")},
       {r6("CASE WHEN n < 3 THEN -1 ELSE mean / 1000 END", "b_sib_period_s")}
FROM (SELECT platform, run_id, p.ProcessGuid, age_ix, count(*) AS n, avg(s.gap) AS mean, stddev_pop(s.gap) AS sd
      FROM gaps p JOIN gaps s USING (platform, run_id, parent, img) JOIN ages ON s.at <= p.at + age GROUP BY ALL)
""", _AGES.replace("1000000000000.0", "10000000.0"), f"""procs AS (SELECT {KEY},
    arg_min(ParentProcessGuid, record_id) FILTER (WHERE ParentProcessGuid IS NOT NULL) AS parent,
    lower(regexp_extract(arg_min(Image, record_id), '([^\\\\/]*)$', 1)) AS img, epoch_us(min(UtcTime)) AS us
    FROM ev GROUP BY {KEY} HAVING parent IS NOT NULL), gaps AS (SELECT *, us / 1e6 AS at,
    floor((us - lag(us) OVER (PARTITION BY platform, run_id, parent, img ORDER BY us, ProcessGuid)) / 1000) AS gap
    FROM procs)"""))
def a6_periods(spark, sf):
    meta = features.process_meta(telemetry_table(spark, sf))
    return rounded(features.sibling_context(meta).select(*PROCESS_KEY, "age_ix", "b_sib_period_cv", "b_sib_period_s"))


def _rule_case(tiers):
    arms = " ".join(f"WHEN regexp_matches({c}, {quoted(p)}) THEN {i}"
                    for i, (tier, _, c, p, _) in enumerate(EVIDENCE_TESTS) if tier in tiers)
    return f"CASE {arms} END"


RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{tier}', '{t}', '{c}', {n})" for i, (tier, t, c, _, n) in enumerate(EVIDENCE_TESTS)
) + ") AS t(rule, tier, technique, col, shown))"
_VALUE = "CASE col WHEN 'Image' THEN Image WHEN 'CommandLine' THEN CommandLine WHEN 'ParentCommandLine' THEN " \
         "ParentCommandLine WHEN 'TargetFilename' THEN TargetFilename ELSE TargetObject END"
EVIDENCE = f"""evidence AS (SELECT e.* EXCLUDE (rule), coalesce(tier, 'none') AS tier,
    coalesce(technique, '') AS technique, coalesce(col || '=' || substr({_VALUE}, 1, shown), '') AS evidence
    FROM (SELECT *, {_rule_case(('DIRECT', 'OSBOOK', 'PARENT'))} AS rule FROM ev) e LEFT JOIN rules USING (rule))"""
_TACTIC = "coalesce(CASE substr(technique, 1, 5) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in TACTICS.items()) + " END, 'other')"


@check("f8_evidence", with_ev("SELECT record_id, tier, technique, evidence FROM evidence", RULES, EVIDENCE))
def f8(spark, sf):
    return with_evidence(telemetry_table(spark, sf)).select("record_id", "tier", "technique", "evidence")


@check("f9_tactics_of_techniques", with_ev(f"""
SELECT technique, {_TACTIC} AS tactic, CASE WHEN substr(technique, 1, 5) IN ('T1007', 'T1012', 'T1016', 'T1033', 'T1049',
    'T1057', 'T1069', 'T1082', 'T1083', 'T1087', 'T1518') THEN 'low'
    WHEN technique NOT LIKE 'T%' OR technique LIKE 'T1059%' THEN 'medium' ELSE 'high' END AS severity, count(*) AS n
FROM evidence GROUP BY ALL""", RULES, EVIDENCE))
def f9(spark, sf):
    from hosttrace.functions.rules import tactic
    named = with_evidence(telemetry_table(spark, sf)).groupBy("technique").agg(F.count(F.lit(1)).alias("n"))
    t = F.col("technique")
    return named.select(t, tactic(t).alias("tactic"), severity(t).alias("severity"), "n")


@check("a7_tactic_counts", with_ev(f"""
SELECT {KEY}, {', '.join(f"count(*) FILTER (WHERE {_TACTIC} = '{n}') AS t_{n}" for n in TACTIC_NAMES)}
FROM evidence WHERE tier = 'DIRECT' GROUP BY {KEY}""", RULES, EVIDENCE))
def a7(spark, sf):
    return features.tactic_counts(telemetry_table(spark, sf))


@check("p14_truth_known", with_ev(f"""
SELECT {KEY}, bool_and(coalesce(label IN (0, 1), false)) AS truth_known, max(label) AS label
FROM (SELECT * REPLACE (CASE WHEN size >= 2 THEN label END AS label) FROM ev) GROUP BY {KEY}"""))
def p14(spark, sf):
    partly = telemetry(spark, sf).withColumn("label", F.when(F.col("size") >= 2, F.col("label")))
    return truth_known(partly, PROCESS_KEY)


@check("w2_age_since_start", with_ev(
    f"SELECT record_id, {r6('since', 'age')}, age_ix FROM (SELECT record_id, since, min(age_ix) AS age_ix FROM aged "
    "JOIN ages ON since <= age GROUP BY ALL)", _AGES, _AGED))
def w2(spark, sf):
    aged, _ = features._aged(telemetry(spark, sf), PROCESS_KEY)
    age = (F.unix_micros("UtcTime") - F.unix_micros("start")) / F.lit(1e6)
    return rounded(aged.select("record_id", age.alias("age"), F.col("bin").alias("age_ix")))
