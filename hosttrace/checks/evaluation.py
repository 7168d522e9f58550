"""Network fusion, alerts, thresholds, metrics, splits and orderings."""

from pyspark.sql import functions as F

from hosttrace.checks.features import _entropy_sql
from hosttrace.checks.registry import FLOWS, KEY, check, r6, rounded, with_ev
from hosttrace.checks.telemetry import flows, table, telemetry, telemetry_table
from hosttrace.operators import alerts, metrics, network, relations, splits
from hosttrace.operators.ordered import quantiles
from hosttrace.session import materialize

# --- network ------------------------------------------------------------------------------------------------------

_KEYED = """e3 AS (SELECT *, run_id AS session_, concat_ws('|', coalesce(SourceIp, ''), coalesce(CAST(SourcePort AS
    VARCHAR), ''), coalesce(DestinationIp, ''), coalesce(CAST(DestinationPort AS VARCHAR), ''),
    coalesce(lower(Protocol), '')) AS fkey, epoch_us(UtcTime) / 1e6 AS ts FROM ev WHERE EventID = 3),
    fk AS (SELECT *, concat_ws('|', orig_h, orig_p, resp_h, resp_p, proto) AS fkey FROM fl)"""


def _sides(spark, sf):
    e = telemetry_table(spark, sf).withColumn("session", F.col("run_id"))
    return network.keyed_events(e), network.keyed_flows(flows(spark, sf))


@check("f15_flow_keys", with_ev("SELECT record_id, fkey FROM e3", FLOWS, _KEYED))
def f15(spark, sf):
    return _sides(spark, sf)[0].select("record_id", "fkey")


_OFFSET = """pairs AS (SELECT e.session_ AS session, f.ts - e.ts AS delta FROM
    (SELECT session_, fkey, min(ts) AS ts FROM e3 GROUP BY ALL HAVING count(*) = 1) e JOIN
    (SELECT session, fkey, min(ts) AS ts FROM fk GROUP BY ALL HAVING count(*) = 1) f
    ON e.session_ = f.session AND e.fkey = f.fkey)"""


@check("j4_clock_offset", with_ev(
    f"SELECT session, {r6('median(delta)', '\"offset\"')}, count(*) AS offset_n FROM pairs GROUP BY session",
    FLOWS, _KEYED, _OFFSET))
def j4(spark, sf):
    return rounded(network.clock_offset(*_sides(spark, sf)))


_NEAREST = """near AS (SELECT record_id, f.session AS session, uid, abs(f.ts - e.ts) AS dt, row_number() OVER (
    PARTITION BY record_id ORDER BY abs(f.ts - e.ts), f.ts) AS rn FROM e3 e JOIN fk f
    ON f.session = e.session_ AND f.fkey = e.fkey AND abs(f.ts - e.ts) <= 3)"""


@check("j5_nearest_flow", with_ev(f"SELECT record_id, session, uid, {r6('dt', 'dt')} FROM near WHERE rn = 1",
                                  FLOWS, _KEYED, _NEAREST))
def j5(spark, sf):
    return rounded(network.nearest_flow(*_sides(spark, sf)).select("record_id", "session", "uid", "dt"))


# Within 3 s no two events of the given tables compete for a flow, so the nearest flow is also the one-to-one match.
@check("j5_one_to_one_match", with_ev(f"""SELECT record_id, f.session AS session, uid, {r6('abs(f.ts - e.ts - 0.25)', 'dt')}
FROM e3 e JOIN fk f ON f.session = e.session_ AND f.fkey = e.fkey AND uid = 'C' || record_id""", FLOWS, _KEYED))
def j5_match(spark, sf):
    ev, fl = _sides(spark, sf)
    offsets = network.clock_offset(ev, fl)
    # With the offset removed every event meets its own flow exactly; six digits hide the last bits of the clock.
    return rounded(network.match_flows(ev, fl, offsets).select("record_id", "session", "uid", "dt"))


# Events of a key are served one after another in log order, each with the flows that the ones before have left.
_SERVED = """evk AS MATERIALIZED (SELECT session_ AS session, fkey, record_id, ts, row_number() OVER (PARTITION BY session_, fkey
    ORDER BY record_id) AS k FROM e3),
flk AS MATERIALIZED (SELECT session, fkey, list({'ts': ts, 'uid': uid} ORDER BY ts, uid) AS flows FROM fk GROUP BY ALL),
served AS (SELECT session, fkey, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS record_id,
    CAST(NULL AS VARCHAR) AS uid, CAST(NULL AS DOUBLE) AS dt FROM flk
    UNION ALL
    SELECT session, fkey, k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.uid) END, record_id, best.uid, best.d
    FROM (SELECT e.session, e.fkey, e.k, s.used, e.record_id, list_sort(list_transform(
              list_filter(f.flows, lambda x: NOT list_contains(s.used, x.uid) AND abs(x.ts - e.ts) <= 21600),
              lambda x: {'d': abs(x.ts - e.ts), 't': x.ts, 'uid': x.uid}))[1] AS best
          FROM served s JOIN evk e ON e.session = s.session AND e.fkey = s.fkey AND e.k = s.k + 1
          JOIN flk f ON f.session = s.session AND f.fkey = s.fkey))"""


@check("j5_contested_match", with_ev(f"SELECT session, record_id, uid, {r6('dt', 'dt')} FROM served WHERE uid IS NOT NULL",
                                     FLOWS, _KEYED, _SERVED))
def j5_wide(spark, sf):
    return rounded(network.match_flows(*_sides(spark, sf), window=6 * 3600.0))


@check("j6_match_summary", with_ev("""
SELECT s.session, events, flows, matched, events - matched AS unmatched_events, flows - matched AS orphan_flows,
       round(100.0 * matched / events, 6) AS match_rate FROM
    (SELECT session_ AS session, count(*) AS events FROM e3 GROUP BY 1) s JOIN
    (SELECT session, count(*) AS flows FROM fk GROUP BY 1) f ON f.session = s.session JOIN
    (SELECT session_ AS session, count(*) FILTER (WHERE 'C' || record_id IN (SELECT uid FROM fk)) AS matched
     FROM e3 GROUP BY 1) m ON m.session = s.session""", FLOWS, _KEYED))
def j6(spark, sf):
    ev, fl = _sides(spark, sf)
    return rounded(network.match_summary(ev, fl, network.match_flows(ev, fl)))


def _set(c, where="true", chars=None):
    text = f"string_agg(DISTINCT {c}, '|' ORDER BY {c}) FILTER (WHERE {c} IS NOT NULL AND {where})"
    return f"coalesce({f'substr({text}, 1, {chars})' if chars else text}, '')"


_ENT = _entropy_sql("split_part(dns_query, '.', 1)")


def _spacing(keys, name):
    return f"""{name}_gap AS (SELECT *, epoch_us(UtcTime) - lag(epoch_us(UtcTime)) OVER (PARTITION BY {keys} ORDER BY
    UtcTime, record_id) AS gap FROM dsts), {name} AS (SELECT {keys}, count(*) AS n, avg(gap) / 1e6 AS mean_s,
    stddev_pop(gap) / 1e6 AS sd_s, stddev_pop(gap) / avg(gap) AS cv FROM {name}_gap GROUP BY {keys}
    HAVING count(*) >= 3 AND sum(gap) > 0)"""


def _beacon_sql(keys, source):
    """(select, CTEs) of the most regular destination for each value of ``keys`` (two columns)."""
    one, two = keys
    on = lambda t: f"{t}.{one} = a.{one} AND {t}.{two} = a.{two}"
    select = f"""
SELECT a.{one}, a.{two}, coalesce(b.n, a.n) AS beacon_n,
       round(CASE WHEN b.n IS NULL THEN o.mean_s ELSE b.mean_s END, 3) AS beacon_mean_s,
       round(CASE WHEN b.n IS NULL THEN o.sd_s ELSE b.sd_s END, 3) AS beacon_sd_s,
       round(CASE WHEN b.n IS NULL THEN o.cv ELSE b.cv END, 4) AS beacon_cv, coalesce(b.dst, '') AS beacon_dst
FROM (SELECT {one}, {two}, count(*) AS n FROM dsts GROUP BY ALL) a
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {one}, {two} ORDER BY cv, dst) AS rn FROM per_dst WHERE n >= 4) b
ON {on('b')} AND b.rn = 1 LEFT JOIN overall o ON {on('o')}"""
    dsts = f"""dsts AS (SELECT *, coalesce(DestinationIp, '') || ':' || coalesce(CAST(DestinationPort AS VARCHAR), '') AS dst FROM {source})"""
    return select, [dsts, _spacing(f"{one}, {two}, dst", "per_dst"), _spacing(f"{one}, {two}", "overall")]


_BY_DAY, _DAY_PARTS = _beacon_sql(("computer", "day"), "(SELECT *, run_id AS day FROM ev WHERE EventID = 3)")
_BY_PROCESS, _PROCESS_PARTS = _beacon_sql(("session_", "ProcessGuid"), "e3")


@check("a9_beacon_regularity", with_ev(_BY_DAY, *_DAY_PARTS))
def a9(spark, sf):
    e = telemetry_table(spark, sf).where("EventID = 3").withColumn("day", F.col("run_id"))
    return network.beacon_regularity(e, ("computer", "day"))


@check("a8_process_network", with_ev(f"""
SELECT n.* EXCLUDE (session_), session_ AS session, beacon_n, beacon_mean_s, beacon_sd_s, beacon_cv, beacon_dst FROM (SELECT session_, ProcessGuid, arg_min(Image, record_id) AS Image, arg_min("User", record_id) AS "User",
       arg_min(label, record_id) AS label, count(*) AS flow_n, count(uid) AS flow_matched,
       count(DISTINCT DestinationIp) AS dst_ip_n, count(DISTINCT DestinationPort) AS dst_port_n,
       CAST(sum(orig_bytes) AS BIGINT) AS bytes_sent, CAST(sum(resp_bytes) AS BIGINT) AS bytes_recv,
       round(sum(duration), 3) AS dur_total_s, round(max(duration), 3) AS dur_max_s,
       count(DISTINCT DestinationIp) FILTER (WHERE NOT regexp_matches(DestinationIp, '^(192\\.168\\.|127\\.)'))
       AS ext_dst_n, count(dns_query) AS dns_n, CAST(coalesce(max(length(dns_query)), 0) AS INT) AS dns_qlen_max,
       round(coalesce(max({_ENT}), 0), 3) AS dns_ent_max, count(http_host) AS http_n,
       count(ssl_server_name) AS ssl_n, {_set('service')} AS svc_set, {_set('conn_state')} AS conn_state_set,
       {_set('http_user_agent', 'http_host IS NOT NULL', 200)} AS http_ua_set,
       {_set('ssl_server_name', chars=200)} AS ssl_sni_set
FROM e3 LEFT JOIN (SELECT * EXCLUDE (ts, fkey, session) FROM fk) f ON f.uid = 'C' || record_id
GROUP BY session_, ProcessGuid) n LEFT JOIN ({_BY_PROCESS}) b USING (session_, ProcessGuid)""", FLOWS, _KEYED, *_PROCESS_PARTS))
def a8(spark, sf):
    ev, fl = _sides(spark, sf)
    fused = materialize(network.fuse(ev, fl, network.match_flows(ev, fl)), "fused")
    return network.process_network(fused)


# --- alerts -------------------------------------------------------------------------------------------------------

_HOT = "hot AS (SELECT platform, run_id, epoch_us(UtcTime) AS t, label FROM ev WHERE size >= 30)"


def _flags(spark, sf):
    return telemetry_table(spark, sf).where("size >= 30").select(
        "platform", "run_id", F.unix_micros("UtcTime").alias("at"), "label")


def _alert_sql(window, least):
    w = window * 1_000_000
    return with_ev(f"""
SELECT platform, run_id, t AS "at", CAST(bad > 0 AS INT) AS true_alert FROM walk""", _HOT, f"""
    cand AS (SELECT platform, run_id, t, bad, row_number() OVER (PARTITION BY platform, run_id ORDER BY t) AS i FROM (
        SELECT h.platform, h.run_id, h.t, count(*) AS n, sum(g.label) AS bad FROM (SELECT DISTINCT platform, run_id, t
        FROM hot) h JOIN hot g ON g.platform = h.platform AND g.run_id = h.run_id AND g.t > h.t - {w} AND g.t <= h.t
        GROUP BY ALL) WHERE n >= {least}), walk AS (SELECT platform, run_id, t, bad FROM cand WHERE i = 1 UNION ALL
        SELECT c.platform, c.run_id, c.t, c.bad FROM walk w JOIN cand c ON c.platform = w.platform
        AND c.run_id = w.run_id WHERE c.t = (SELECT min(d.t) FROM cand d WHERE d.platform = w.platform
        AND d.run_id = w.run_id AND d.t >= w.t + {w}))""")


@check("w5_window_alerts", _alert_sql(3600, 1))
def w5(spark, sf):
    return alerts.window_alerts(_flags(spark, sf), 3600, 1).withColumn("true_alert", F.col("true_alert").cast("int"))


@check("w5_window_alerts_burst", _alert_sql(7200, 4))
def w5_burst(spark, sf):
    return alerts.window_alerts(_flags(spark, sf), 7200, 4).withColumn("true_alert", F.col("true_alert").cast("int"))


_LADDER = [0.0, 60.0, 3600.0, float("inf")]


def _scores(spark, sf):
    e = telemetry_table(spark, sf)
    start = e.groupBy("platform", "run_id", "ProcessGuid").agg(
        F.min("UtcTime").alias("start"), F.max("UtcTime").alias("end"), F.max("label").alias("label"),
        F.max("size").alias("top"), F.min("computer").alias("lineage"))
    return start.withColumn("age_ix", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "score", F.col("top") * (F.col("age_ix") + 1) / 4)


_DET = f"""p AS (SELECT {KEY}, epoch_us(min(UtcTime)) AS s, epoch_us(max(UtcTime)) AS e, max(label) AS label,
    max(size) AS top, min(computer) AS lineage FROM ev GROUP BY {KEY}), det AS (SELECT *, CASE WHEN top / 4 >= 20 THEN s
    WHEN top / 2 >= 20 THEN s + 60000000 WHEN top * 3 / 4 >= 20 THEN s + 3600000000 WHEN top >= 20 THEN e END AS d
    FROM p)"""


def _detections(spark, sf):
    scores = _scores(spark, sf)
    lineage = scores.where("age_ix = 0").select("platform", "run_id", "ProcessGuid", "lineage")
    return alerts.first_detection(scores, _LADDER, 20.0).join(lineage, ["platform", "run_id", "ProcessGuid"])


@check("w6_first_detection", with_ev(f"SELECT {KEY}, d AS det FROM det", _DET))
def w6(spark, sf):
    return _detections(spark, sf).select("platform", "run_id", "ProcessGuid", F.unix_micros("det").alias("det"))


@check("w7_incidents", with_ev(f"""
SELECT platform, run_id, lineage, count(*) AS n_proc, CAST(count(d) >= 2 AS INT) AS detected,
       {r6('(min(d) FILTER (WHERE rn = 2) - min(s)) / 1e6', 'ttd_s')} FROM (SELECT *, CASE WHEN d IS NOT NULL THEN
       row_number() OVER (PARTITION BY platform, run_id, lineage, d IS NULL ORDER BY d, ProcessGuid) END AS rn
       FROM det WHERE label = 1) GROUP BY ALL""", _DET))
def w7(spark, sf):
    return rounded(alerts.incidents(_detections(spark, sf), k=2))


@check("w11_false_alarms_per_hour", with_ev(f"""
SELECT platform, run_id, benign_trees, false_alarms, {r6('hours', 'hours')}, {r6('false_alarms / hours', 'fa_per_hour')}
FROM (SELECT platform, run_id, count(*) AS benign_trees, count(*) FILTER (WHERE hits >= 1) AS false_alarms FROM (
    SELECT platform, run_id, lineage, max(label) AS mal, count(d) AS hits FROM det GROUP BY ALL) WHERE mal = 0
    GROUP BY ALL) JOIN (SELECT platform, run_id, (epoch_us(max(UtcTime)) - epoch_us(min(UtcTime))) / 3.6e9 AS hours
    FROM ev GROUP BY ALL) USING (platform, run_id)""", _DET.replace("min(computer)", "min(ProcessGuid)")))
def w11(spark, sf):
    found = _detections(spark, sf).withColumn("lineage", F.col("ProcessGuid"))
    return rounded(alerts.false_alarms(found, alerts.run_hours(telemetry_table(spark, sf))))


def _summary_sql(window, least):
    flagged = _DET + """, hot AS (SELECT platform, run_id, d AS t, label FROM det WHERE d IS NOT NULL)"""
    return _alert_sql(window, least).replace(_HOT, flagged).split("\nSELECT platform, run_id, t AS")[0] + """
SELECT platform, run_id, CAST(attacks > 0 AS INT) AS attack_run, coalesce(alerts, 0) AS alerts,
       coalesce(hits, 0) AS true_alerts, coalesce(alerts - hits, 0) AS false_alarms,
       CASE WHEN attacks > 0 THEN CAST(coalesce(hits, 0) > 0 AS INT) END AS detected,
       round(CASE WHEN attacks > 0 THEN (hit_at - attack_at) / 1e6 END, 6) AS ttd_s
FROM (SELECT platform, run_id, count(*) FILTER (WHERE label = 1) AS attacks, min(s) FILTER (WHERE label = 1) AS attack_at
      FROM det GROUP BY ALL) LEFT JOIN (SELECT platform, run_id, count(*) AS alerts, count(*) FILTER (WHERE bad > 0)
      AS hits, min(t) FILTER (WHERE bad > 0) AS hit_at FROM walk GROUP BY ALL) USING (platform, run_id)"""


@check("m25_host_alert_summary", _summary_sql(3600, 2))
def m25(spark, sf):
    return rounded(alerts.host_alert_summary(materialize(_detections(spark, sf), "detections"), 3600, 2))


@check("m25_alert_grid", " UNION ALL ".join(
    f'SELECT *, {w} AS "W", {n} AS "N" FROM ({_summary_sql(w, n)})' for w in (60, 300) for n in (1, 2, 3)))
def m25_grid(spark, sf):
    return rounded(alerts.alert_grid(materialize(_detections(spark, sf), "detections")))


@check("w3_gaps", with_ev("""
SELECT record_id, epoch_us(UtcTime) - lag(epoch_us(UtcTime)) OVER (PARTITION BY computer ORDER BY UtcTime, record_id)
       AS gap FROM ev"""))
def w3(spark, sf):
    from hosttrace.operators.ordered import lag_of
    e = telemetry(spark, sf).select("record_id", "computer", F.unix_micros("UtcTime").alias("t"))
    return lag_of(e, ["computer"], ["t", "record_id"], "t", "prev").select(
        "record_id", (F.col("t") - F.col("prev")).alias("gap"))


@check("w4_counts_in_range", with_ev("""
SELECT record_id, count(*) OVER (PARTITION BY computer ORDER BY epoch_us(UtcTime) RANGE BETWEEN 3600000000 PRECEDING
       AND CURRENT ROW) AS n FROM ev"""))
def w4(spark, sf):
    from hosttrace.operators.ordered import lookup_prefix
    e = telemetry(spark, sf).select("record_id", "computer", F.unix_micros("UtcTime").alias("t"),
                                    F.lit(1).cast("long").alias("one"))
    points = materialize(e, "points")
    upto = lookup_prefix(points, points.select("record_id", "computer", "t"), ["computer"], "t", sums={"hi": "one"})
    edge = upto.withColumn("t", F.col("t") - 3_600_000_001)
    both = lookup_prefix(points, edge, ["computer"], "t", sums={"lo": "one"})
    return both.select("record_id", (F.col("hi") - F.col("lo")).alias("n"))


# --- metrics ------------------------------------------------------------------------------------------------------

_PRED = """pred AS (SELECT doc_id, lang, quality AS label, n_chars AS score, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END
    AS pred FROM documents JOIN labels USING (doc_id))"""


def _predictions(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", "lang", n).join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("label"), n.cast("double").alias("score"),
        F.when(n > 2000, 1).otherwise(0).alias("pred"))


_CELLS = ", ".join(f"count(*) FILTER (WHERE label = {y} AND pred = {p}) AS {n}"
                   for n, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
_METRICS = ", ".join([
    "tp, fp, fn, tn", r6("(tp + tn) / (tp + fp + fn + tn)", '"Accuracy"'),
    r6("coalesce(tp / nullif(tp + fp, 0), 0)", '"Precision"'), r6("coalesce(tp / nullif(tp + fn, 0), 0)", '"Recall"'),
    r6("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", '"F1"'), r6("fp / nullif(fp + tn, 0)", '"FPR"'),
    r6("(tp + fp) / (tp + fp + fn + tn)", '"Flag_Rate"')])


@check("m20_confusion_metrics", f"WITH {_PRED} SELECT {_METRICS} FROM (SELECT {_CELLS} FROM pred)")
def m20(spark, sf):
    return rounded(metrics.confusion_metrics(_predictions(spark, sf)))


@check("m23_pooled_and_by_group", f"""WITH {_PRED} SELECT coalesce(lang, 'all') AS lang, {_METRICS}
FROM (SELECT lang, {_CELLS} FROM pred GROUP BY GROUPING SETS ((), (lang)))""")
def m23(spark, sf):
    return rounded(metrics.pooled_and_by(_predictions(spark, sf), "lang"))


@check("m21_roc_auc", f"""WITH {_PRED} SELECT lang, count(*) FILTER (WHERE label = 1) AS n_pos,
       count(*) FILTER (WHERE label = 0) AS n_neg, {r6('''(sum(r) FILTER (WHERE label = 1)
       - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
       / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0))''', '"AUC"')}
FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r
      FROM pred) GROUP BY lang""")
def m21(spark, sf):
    return rounded(metrics.roc_auc(_predictions(spark, sf), ["lang"]))


@check("m21_roc_points", f"""WITH {_PRED} SELECT CAST(score AS DOUBLE) AS threshold, tp, fp,
       {r6('tp / (SELECT count(*) FROM pred WHERE label = 1)', 'tpr')},
       {r6('fp / (SELECT count(*) FROM pred WHERE label = 0)', 'fpr')} FROM (
    SELECT score, CAST(sum(count(*) FILTER (WHERE label = 1)) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
           CAST(sum(count(*) FILTER (WHERE label = 0)) OVER (ORDER BY score DESC) AS BIGINT) AS fp
    FROM pred GROUP BY score)""")
def m21_points(spark, sf):
    return rounded(metrics.roc_points(_predictions(spark, sf)))


@check("m22_baselines", f"""WITH {_PRED} SELECT lang, {r6('avg(label)', 'all_positive_accuracy')},
       {r6('2 * avg(label) / (1 + avg(label))', 'all_positive_f1')}, {r6('1 - avg(label)', 'all_benign_accuracy')},
       {r6('greatest(avg(label), 1 - avg(label))', 'majority_accuracy')} FROM pred GROUP BY lang""")
def m22(spark, sf):
    return rounded(metrics.baselines(_predictions(spark, sf), ["lang"]))


_THR = r6("quantile_cont(score, 0.95)", "threshold")


@check("m18_benign_threshold", f"WITH {_PRED} SELECT lang, {_THR} FROM pred WHERE label = 0 GROUP BY lang")
def m18(spark, sf):
    return rounded(metrics.benign_threshold(_predictions(spark, sf), ["lang"]))


@check("m18_other_group_threshold", f"""WITH {_PRED} SELECT g.lang, {_THR} FROM (SELECT DISTINCT lang FROM pred) g
JOIN pred p ON p.lang <> g.lang WHERE label = 0 GROUP BY g.lang""")
def m18_other(spark, sf):
    return rounded(metrics.other_group_threshold(_predictions(spark, sf), "lang"))


@check("m18_threshold_applied", f"""WITH {_PRED} SELECT doc_id, CAST(score > t AS INT) AS pred FROM pred JOIN
(SELECT lang, quantile_cont(score, 0.95) AS t FROM pred WHERE label = 0 GROUP BY lang) USING (lang)""")
def m18_applied(spark, sf):
    p = _predictions(spark, sf).drop("pred")
    return metrics.apply_threshold(p, metrics.benign_threshold(p, ["lang"]), ["lang"]).select("doc_id", "pred")


@check("w8_halves_by_start", with_ev("""
SELECT record_id, epoch_us(UtcTime) > m AS late FROM ev JOIN (
    SELECT computer, median(epoch_us(UtcTime)) AS m FROM ev GROUP BY 1) USING (computer)"""))
def w8(spark, sf):
    e = telemetry(spark, sf).select("record_id", "computer", F.col("UtcTime").alias("start"))
    return metrics.halves_by_start(e, "computer").select("record_id", "late")


@check("m19_tune_contamination", f"""WITH {_PRED}, flagged AS (SELECT c, label, CASE WHEN score >= t THEN 1 ELSE 0 END
    AS pred FROM (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]) AS c,
    unnest(quantile_cont(score, [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4])) AS t FROM pred)
    CROSS JOIN (SELECT label, score FROM pred))
SELECT CAST(c AS DOUBLE) AS contamination, {_METRICS} FROM (SELECT c, {_CELLS} FROM flagged GROUP BY c)""")
def m19(spark, sf):
    return rounded(metrics.tune_contamination(materialize(_predictions(spark, sf).drop("pred"), "scores")))


# --- splits and orderings -----------------------------------------------------------------------------------------

def _bucket(g, seed, k):
    return f"CAST(CAST('0x' || substr(md5(CAST({g} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT) % {k} AS INT)"


@check("m6_group_shuffle", f"SELECT o_orderkey, {_bucket('o_custkey', 0, 10000)} < 3000 AS is_test FROM orders")
def m6(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return splits.group_shuffle(o, "o_custkey").drop("o_custkey")


@check("m6_benign_train_split", f"""SELECT o_orderkey, NOT (o_totalprice < 150000 AND
       {_bucket('o_orderkey', 0, 10000)} < 9000) AS is_test FROM orders""")
def m6_benign(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") < 150000, 0).otherwise(1).alias("label"))
    return splits.benign_train_split(o, "o_orderkey").drop("label")


@check("m6_stratified_rows", f"""SELECT o_orderkey, h <= quantile_cont(h, 0.3) OVER (PARTITION BY label) AS is_test
FROM (SELECT o_orderkey, o_orderstatus AS label, {_bucket('o_orderkey', 0, 2147483647)} AS h FROM orders)""")
def m6_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    return splits.stratified_rows(o, "o_orderkey").drop("label")


@check("m8_run_index_folds", with_ev("""
SELECT record_id, CAST((dense_rank() OVER (PARTITION BY platform, session ORDER BY run_id) - 1) % 3 AS INT) AS fold FROM ev"""))
def m8(spark, sf):
    return splits.run_index_folds(telemetry(spark, sf), 3).select("record_id", "fold")


@check("m7_stratified_group_folds", with_ev("""
SELECT fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM ev JOIN (
    SELECT ProcessGuid, CAST((row_number() OVER (PARTITION BY class ORDER BY pos DESC, n DESC, md5(ProcessGuid || '|0'), ProcessGuid) - 1
        + CAST('0x' || substr(md5(class || '|0'), 1, 8) AS BIGINT) % 5) % 5 AS INT) AS fold
    FROM (SELECT ProcessGuid, sum(label) AS pos, count(*) AS n,
                 length(bin(CAST(sum(label) + 1 AS BIGINT))) || '/' || length(bin(count(*))) AS class FROM ev GROUP BY 1)) USING (ProcessGuid)
GROUP BY fold"""))
def m7(spark, sf):
    p = telemetry(spark, sf).select("ProcessGuid", "label", "record_id")
    return splits.stratified_group_folds(p, "ProcessGuid").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@check("m9_leave_one_out", with_ev("""
SELECT s.session AS held_out, count(*) FILTER (WHERE e.session = s.session) AS n_test,
       count(*) FILTER (WHERE e.session <> s.session) AS n_train
FROM ev e CROSS JOIN (SELECT DISTINCT session FROM ev WHERE session NOT LIKE 'benign%') s GROUP BY 1"""))
def m9(spark, sf):
    return splits.held_out_sizes(telemetry(spark, sf), "session", ~F.col("session").startswith("benign"))


@check("m17_balanced_weight", f"""SELECT DISTINCT toxic AS label, {r6('n / (2 * c)', 'weight')} FROM (
    SELECT toxic, count(*) OVER () AS n, count(*) OVER (PARTITION BY toxic) AS c FROM labels)""")
def m17(spark, sf):
    from hosttrace.operators.models import with_balanced_weight
    rows = with_balanced_weight(table(spark, sf, "labels").select(F.col("toxic").alias("label")))
    return rounded(rows.distinct())


@check("w9_top_per_group", """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def w9(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    top = splits.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return top.select("o_orderkey", "o_custkey")


@check("w10_stratified_sample", """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (
    PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|0'), o_orderkey) AS r
    FROM orders) WHERE r <= 15""")
def w10(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return splits.stratified_sample(o, ["o_orderstatus", "o_orderpriority"], 15, "o_orderkey")


@check("o1_scores_descending", """SELECT o_orderkey, row_number() OVER (ORDER BY s DESC NULLS LAST, o_orderkey) AS position
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS s FROM orders)""")
def o1(spark, sf):
    o = table(spark, sf, "orders")
    score = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return relations.positions(o, [*relations.descending_nulls_last(score), F.col("o_orderkey")]).select("o_orderkey", "position")


@check("o2_busiest_processes", with_ev(f"""
SELECT {KEY}, n FROM (SELECT {KEY}, count(*) AS n FROM ev GROUP BY {KEY}) ORDER BY n DESC, run_id, ProcessGuid LIMIT 15"""))
def o2(spark, sf):
    n = telemetry(spark, sf).groupBy("platform", "run_id", "ProcessGuid").agg(F.count(F.lit(1)).alias("n"))
    return relations.top(n, [F.desc("n"), "run_id", "ProcessGuid"], 15)


@check("o3_top_inside_alert", with_ev("""
SELECT run_id, string_agg(CAST(record_id AS VARCHAR), '|' ORDER BY r) AS top FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY label DESC, size DESC, record_id) AS r FROM ev)
WHERE r <= 10 GROUP BY run_id"""))
def o3(spark, sf):
    order = [F.desc("label"), F.desc("size"), F.col("record_id")]
    return relations.packed_top(telemetry(spark, sf), ["run_id"], order, "record_id", 10)


@check("o4_stable_order", with_ev("""
SELECT record_id, row_number() OVER (ORDER BY platform, run_id, UtcTime, record_id) AS position FROM ev"""))
def o4(spark, sf):
    order = [F.col(c) for c in ("platform", "run_id", "UtcTime", "record_id")]
    return relations.positions(telemetry(spark, sf), order).select("record_id", "position")
