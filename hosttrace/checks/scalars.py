"""Column functions over whole texts."""

from pyspark.sql import functions as F

from hosttrace.checks.features import EVIDENCE, RULES, _entropy_sql, quoted
from hosttrace.checks.registry import check, r6, rounded, with_ev
from hosttrace.checks.telemetry import payload_sql, table, telemetry, telemetry_table
from hosttrace.functions import numeric, rules, text
from hosttrace.schema import EVENT_NAMES
from hosttrace.sources.logs import linux_lines, parse_events

HTML = "html"


@check("p1_entity_unescape", """
SELECT page_id, nullif(nullif(regexp_replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'),
       '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&apos;', ''''), '&#13;', ''), '&#10;', ' '), '^\\s+|\\s+$', '', 'g'),
       ''), '-') AS clean FROM pages""")
def p1(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_value(F.col("html")).alias("clean"))


@check("p13_normal_guid", "SELECT DISTINCT nullif(lower(trim(o_orderpriority)), '') AS guid FROM orders")
def p13(spark, sf):
    return table(spark, sf, "orders").select(text.normal_guid(F.col("o_orderpriority")).alias("guid")).distinct()


@check("p15_scenario_and_family", with_ev("""
SELECT DISTINCT session, replace(session, '_win', '') AS scenario, CASE WHEN session LIKE 'benign%' THEN 'benign'
  WHEN session LIKE 'miner%' THEN 'miner' WHEN session LIKE 'ransomware%' THEN 'ransomware' WHEN session LIKE 'trojan%'
  THEN 'trojan' WHEN session LIKE 'botnet%' THEN 'botnet' WHEN session LIKE 'exploit%' THEN 'exploit' ELSE 'other' END
  AS family FROM ev"""))
def p15(spark, sf):
    s = F.col("session")
    return telemetry(spark, sf).select(s, text.scenario(s).alias("scenario"), text.family(s).alias("family")).distinct()


@check("p16_mask_sample_path", with_ev("""
SELECT record_id, regexp_replace(TargetFilename, '/tmp/[^/\\s''"]+', '/tmp/SAMPLE', 'g') AS target FROM ev"""))
def p16(spark, sf):
    return telemetry(spark, sf).select("record_id", text.mask_sample_path(F.col("TargetFilename")).alias("target"))


@check("p17_parse_time", """
SELECT event_id, epoch_us(date_trunc('milliseconds', ts)) AS us FROM events""")
def p17(spark, sf):
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    iso = F.concat(F.replace(shown, F.lit(" "), F.lit("T")), F.lit("Z"))
    logged = F.when(F.col("event_id") % 2 == 0, shown).otherwise(iso)
    e = table(spark, sf, "events").select("event_id", logged.alias("t"))
    return e.select("event_id", F.unix_micros(numeric.parse_time(F.col("t"))).alias("us"))


@check("f1_entropy", f"SELECT doc_id, {r6(_entropy_sql('text'), 'entropy')} FROM documents")
def f1(spark, sf):
    return rounded(table(spark, sf, "documents").select("doc_id", text.entropy(F.col("text"), long=True).alias("entropy")))


@check("f2_path_parts", """
SELECT page_id, lower(regexp_extract(url, '([^\\\\/]*)$', 1)) AS base,
       nullif(lower(regexp_extract(url, '\\.([A-Za-z0-9]{1,8})$', 1)), '') AS ext FROM pages""".replace(
    "regexp_extract(url, '\\.", "regexp_extract(regexp_extract(url, '([^\\\\/]*)$', 1), '\\."))
def f2(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.basename(u).alias("base"), text.extension(u).alias("ext"))


@check("f3_launcher_unwrap", with_ev(
    f"SELECT record_id, {payload_sql('CommandLine')} AS payload FROM ev WHERE CommandLine IS NOT NULL"))
def f3(spark, sf):
    cmd = F.col("CommandLine")
    return telemetry_table(spark, sf).where(cmd.isNotNull()).select("record_id", text.unwrap_command(cmd).alias("payload"))


def _times(pattern):
    return f"CAST(len(regexp_extract_all(html, {quoted(pattern)})) AS INT)"


def _hit(pattern, column="html"):
    return f"CAST(regexp_matches({column}, {quoted(pattern)}) AS INT)"


@check("f4_command_structure", f"""
SELECT page_id, {_times('\\|')} AS b_pipes, {_times('[0-9]?>>?')} AS b_redirects, {_times('&&|;|[ \\t\\n\\r\\f\\v]&[ \\t\\n\\r\\f\\v]')} AS b_chain,
       {_hit(text.URL)} AS b_url, {_hit(text.IPV4)} AS b_ip_literal, {_hit(text.BASE64_RUN)} AS b_b64,
       {_hit(text.DEV_TCP)} AS b_devtcp, {r6(_entropy_sql('html'), 'b_cmd_entropy')},
       {_hit(text.WRITABLE, 'url')} AS b_exec_writable FROM pages""")
def f4(spark, sf):
    found = text.command_structure(F.col("html"), F.col("url"))
    return rounded(table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in found.items()]))


@check("f5_sensitive_paths", with_ev(f"""
SELECT record_id, regexp_matches(coalesce(TargetFilename, ''), {quoted(text.SENSITIVE)}) OR
       regexp_matches(coalesce(TargetObject, ''), {quoted(text.SENSITIVE)}) AS sensitive FROM ev"""))
def f5(spark, sf):
    return telemetry(spark, sf).select(
        "record_id", text.sensitive(F.col("TargetFilename"), F.col("TargetObject")).alias("sensitive"))


@check("f6_external_ip", with_ev(f"""
SELECT record_id, coalesce(NOT regexp_matches(DestinationIp, {quoted(text.PRIVATE_IP)}), false) AS ext,
       coalesce(NOT regexp_matches(DestinationIp, {quoted(text.LAB_IP)}), false) AS outside FROM ev"""))
def f6(spark, sf):
    ip = F.col("DestinationIp")
    return telemetry(spark, sf).select("record_id", text.external_ip(ip).alias("ext"),
                                       text.outside_lab_ip(ip).alias("outside"))


_BASE = "lower(regexp_extract(Image, '([^\\\\/]*)$', 1))"


@check("f7_harness_mask", with_ev(f"""
SELECT record_id, regexp_matches(coalesce(CommandLine, ''), {quoted(rules.HARNESS_ENGINE)})
    OR regexp_matches(coalesce(CommandLine, ''), {quoted(rules.HARNESS_HELPER)}) OR {_BASE} = 'conhost.exe'
    OR (regexp_matches(coalesce(ParentCommandLine, ''), {quoted(rules.HARNESS_PARENT)}) AND {_BASE} NOT IN
        ('sh', 'bash', 'dash', 'cmd.exe', 'powershell.exe', 'pwsh')) AS harness FROM ev"""))
def f7(spark, sf):
    c = F.col
    return telemetry_table(spark, sf).select(
        "record_id", rules.harness_mask(c("Image"), c("CommandLine"), c("ParentCommandLine")).alias("harness"))


_LEVEL = """CASE WHEN substr(technique, 1, 5) IN ('T1007', 'T1012', 'T1016', 'T1033', 'T1049', 'T1057', 'T1069', 'T1082', 'T1083',
    'T1087', 'T1518') THEN 0 WHEN technique NOT LIKE 'T%' OR technique LIKE 'T1059%' THEN 1 ELSE 2 END"""


@check("f10_alert_severity", with_ev(f"""
SELECT platform, run_id, computer, CASE WHEN count(DISTINCT split_part(technique, ' ', 1)) FILTER (WHERE technique <> '') >= 3 THEN 'high'
    WHEN max({_LEVEL}) = 2 THEN 'high' WHEN max({_LEVEL}) = 1 THEN 'medium' ELSE 'low' END AS severity,
    count(*) AS n_flagged FROM evidence WHERE tier IN ('DIRECT', 'PARENT') GROUP BY ALL""", RULES, EVIDENCE))
def f10(spark, sf):
    from hosttrace.operators.alerts import alert_severity
    hits = rules.with_evidence(telemetry_table(spark, sf)).where("tier IN ('DIRECT', 'PARENT')")
    return alert_severity(hits, ["platform", "run_id", "computer"])


@check("f11_text_lengths", """
SELECT doc_id, coalesce(length(CASE WHEN lang <> 'de' THEN text END), -1) AS n FROM documents""")
def f11(spark, sf):
    t = F.when(F.col("lang") != "de", F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.length_or(t, -1).alias("n"))


@check("f12_wilson_interval", """
SELECT o_orderpriority, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)))
       / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n
       + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM (
    SELECT o_orderpriority, count(*) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) AS p
    FROM orders GROUP BY 1)""")
def f12(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = numeric.wilson(F.col("k"), F.col("n"))
    return rounded(c.select("o_orderpriority", low.alias("low"), high.alias("high")))


@check("f13_numbers_and_percent", f"""
SELECT o_orderkey, coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE), 0) AS number,
       coalesce(TRY_CAST(o_orderstatus AS DOUBLE), 0) AS broken,
       {r6('coalesce(o_custkey * 100.0 / nullif(o_orderkey, 0), 0)', 'pct')} FROM orders""")
def f13(spark, sf):
    return rounded(table(spark, sf, "orders").select(
        "o_orderkey", numeric.number_or(F.substring("o_orderpriority", 1, 1)).alias("number"),
        numeric.number_or(F.col("o_orderstatus")).alias("broken"),
        numeric.percent(F.col("o_custkey"), F.col("o_orderkey")).alias("pct")))


@check("f14_seed_match", with_ev("""
SELECT record_id FROM ev WHERE contains(Image, '/bin/') OR contains(lower(CommandLine), 'schtasks')
    OR starts_with(CurrentDirectory, 'C:\\lab_sandbox') OR starts_with(Image, 'C:\\lab_sandbox')"""))
def f14(spark, sf):
    return telemetry_table(spark, sf).where(
        rules.seed_match(["/bin/"], ["SCHTASKS"], [r"C:\lab_sandbox"])).select("record_id")


@check("f16_hash_and_truncate", """
SELECT doc_id, sha256(text) AS digest, substr(text, 1, 88) AS head, split_part(text, '.', 1) AS first FROM documents""")
def f16(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("digest"),
                                                F.substring(t, 1, 88).alias("head"), text.first_label(t).alias("first"))


@check("k6_formula_safe", """
SELECT turn, conv_id, CASE WHEN regexp_matches(text, '^\\s*[=+\\-@]') THEN '''' || text ELSE text END AS safe
FROM conversations""")
def k6(spark, sf):
    return table(spark, sf, "conversations").select("turn", "conv_id", text.formula_safe(F.col("text")).alias("safe"))


@check("s3_parse_event_lines", """
SELECT event_id AS record_id, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 11 ELSE 77
       END AS INT) AS "EventID", CASE event_type WHEN 'view' THEN 'ProcessCreate' WHEN 'click' THEN 'NetworkConnect'
       WHEN 'purchase' THEN 'FileCreate' ELSE 'Unknown_77' END AS event_name, '{' || user_id || '}' AS "ProcessGuid",
       CAST(user_id AS INT) AS "ProcessId", 'host' || (user_id % 3) AS computer, props AS "CommandLine",
       '10.0.0.1' AS host_ip, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS parent_known
FROM events WHERE event_type <> 'error'""")
def s3(spark, sf):
    return parse_events(linux_lines(event_lines(spark, sf)), "linux").select(
        "record_id", "EventID", "event_name", "ProcessGuid", "ProcessId", "computer", "CommandLine", "host_ip",
        "parent_known")


def event_lines(spark, sf):
    """Log lines spelled from the rows of `events`; `error` rows become the sensor's own messages."""
    c = F.col
    event = (F.when(c("event_type") == "view", "1").when(c("event_type") == "click", "3")
             .when(c("event_type") == "purchase", "11").when(c("event_type") == "error", "255").otherwise("77"))
    parent = F.when(c("user_id") % 2 == 0, "{p}").otherwise("{00000000-0000-0000-0000-000000000000}")

    def data(name, value):
        return F.concat(F.lit(f'<Data Name="{name}">'), value.cast("string"), F.lit("</Data>"))

    quoted_props = F.replace(c("props"), F.lit('"'), F.lit("&quot;"))
    line = F.concat(
        F.lit("2026-01-01\t10.0.0.1\t<14>sensor: <Event><System><EventID>"), event, F.lit("</EventID><EventRecordID>"),
        c("event_id").cast("string"), F.lit("</EventRecordID><Computer>host"), (c("user_id") % 3).cast("string"),
        F.lit("</Computer></System><EventData>"), data("ProcessId", F.lit("999999")),
        data("ProcessGuid", F.concat(F.lit("{"), c("user_id").cast("string"), F.lit("}"))),
        data("ProcessId", c("user_id")), data("User", F.lit("-")), F.lit('<Data Name="Image"/>'),
        data("CommandLine", quoted_props), data("ParentProcessGuid", parent), F.lit("</EventData></Event>"))
    return table(spark, sf, "events").select(line.alias("value"), F.lit("s").alias("session"))


_NAMED = "CASE CAST(id AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EVENT_NAMES.items()) + " ELSE 'Unknown_' || CAST(id AS VARCHAR) END"


@check("s4_event_ids", f"""
SELECT event_id AS record_id, CAST(id AS INT) AS "EventID", {_NAMED} AS event_name,
       CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS parent_known
FROM (SELECT *, event_id % 29 AS id FROM events) WHERE id NOT IN (27, 28)""")
def s4(spark, sf):
    """Every event id from 0 to 26; the sensor's own messages (255) and records without an id go."""
    c, id_ = F.col, F.col("event_id") % 29
    parent = F.when(c("user_id") % 3 == 0, "{p}").when(c("user_id") % 3 == 1, "{00000000-0000-0000-0000-000000000000}").otherwise("-")
    payload = F.concat(
        F.when(id_ == 28, F.lit("<System>")).otherwise(F.concat(F.lit("<System><EventID>"), F.when(id_ == 27, "255").otherwise(id_.cast("string")), F.lit("</EventID>"))),
        F.lit("<EventRecordID>"), c("event_id").cast("string"), F.lit('</EventRecordID></System><EventData><Data Name="ParentProcessGuid">'),
        parent, F.lit("</Data></EventData>"))
    records = table(spark, sf, "events").select(F.lit("s").alias("session"), F.lit("t").alias("recv_timestamp"), F.lit("h").alias("host_ip"), payload.alias("payload"))
    return parse_events(records, "linux").select("record_id", "EventID", "event_name", "parent_known")


@check("j3_side_logs", """
WITH dns AS (SELECT user_id, arg_min(props, event_id) AS q FROM events WHERE event_type = 'signup' GROUP BY 1),
     http AS (SELECT user_id, arg_min(props, event_id) FILTER (WHERE value > 20) AS h FROM events
              WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, q AS dns_query, h AS http_host FROM events LEFT JOIN dns USING (user_id) LEFT JOIN http USING (user_id)
WHERE event_type = 'click'""")
def j3(spark, sf):
    from hosttrace.operators.network import attach_side_logs
    c = F.col
    e = table(spark, sf, "events").withColumn("uid", c("user_id").cast("string"))
    logs = {"dns": e.where("event_type = 'signup'").select("uid", c("props").alias("query"), c("event_id").alias("line_no")),
            "http": e.where("event_type = 'purchase'").select(
                "uid", F.when(c("value") > 20, c("props")).otherwise("").alias("host"), c("event_id").alias("line_no"))}
    conn = e.where("event_type = 'click'").select("event_id", "uid")
    return attach_side_logs(conn, logs).select("event_id", "dns_query", "http_host")


@check("j8_children_within", with_ev("""
SELECT p.platform, p.run_id, p.ProcessGuid, count(*) AS kids FROM (SELECT platform, run_id, ProcessGuid, min(UtcTime) AS s
    FROM ev GROUP BY ALL) p JOIN ev c ON c.platform = p.platform AND c.run_id = p.run_id
    AND c.ParentProcessGuid = p.ProcessGuid AND c.EventID = 1 AND epoch_us(c.UtcTime) - epoch_us(p.s) <= 300000000
GROUP BY ALL"""))
def j8(spark, sf):
    from hosttrace.operators import features
    from hosttrace.schema import PROCESS_KEY
    e = telemetry_table(spark, sf)
    starts = e.groupBy(*PROCESS_KEY).agg(F.min("UtcTime").alias("start"))
    born = features._children(e, starts, PROCESS_KEY).where(F.col("bin") <= features.AGES.index(300.0))
    return born.groupBy(*PROCESS_KEY).agg(F.sum("b_children").alias("kids"))


@check("j9_created_then_deleted", with_ev("""
SELECT run_id, count(*) AS paths FROM (SELECT run_id, computer, lower(TargetFilename) AS p FROM ev
    WHERE EventID IN (11, 23) GROUP BY ALL HAVING count(DISTINCT EventID) = 2) GROUP BY run_id"""))
def j9(spark, sf):
    e = telemetry(spark, sf).where("EventID IN (11, 23)")
    both = e.groupBy("run_id", "computer", F.lower("TargetFilename").alias("p")).agg(
        F.count_if(F.col("EventID") == 11).alias("made"), F.count_if(F.col("EventID") == 23).alias("gone"))
    return both.where("made > 0 AND gone > 0").groupBy("run_id").agg(F.count(F.lit(1)).alias("paths"))
