"""All 53 features with their description, against the SQL of the parts."""

from pyspark.sql import functions as F

from hosttrace.checks.features import _entropy_sql, quoted
from hosttrace.checks.registry import KEY, SQL, check, r6, rounded, with_ev
from hosttrace.checks.streams import _HARNESS
from hosttrace.checks.telemetry import payload_sql, telemetry_table
from hosttrace.functions import text
from hosttrace.operators import features


def _times(pattern):
    return f"CAST(len(regexp_extract_all(payload, {quoted(pattern)})) AS DOUBLE)"


def _hit(pattern, column="payload"):
    return f"CAST(regexp_matches(coalesce({column}, ''), {quoted(pattern)}) AS DOUBLE)"


def _first(column):
    return f"arg_min({column}, record_id) FILTER (WHERE {column} IS NOT NULL)"


_DESCRIBED = f"""
SELECT {KEY}, label, session, replace(session, '_win', '') AS scenario, {_HARNESS} AS harness, s AS "start", e AS "end", ParentProcessGuid,
       {_times('[|]')} AS b_pipes, {_times('[0-9]?>>?')} AS b_redirects, {_times('&&|;|[ \\t\\n\\r\\f\\v]&[ \\t\\n\\r\\f\\v]')} AS b_chain,
       {_hit(text.URL)} AS b_url, {_hit(text.IPV4)} AS b_ip_literal, {_hit(text.BASE64_RUN)} AS b_b64, {_hit(text.DEV_TCP)} AS b_devtcp,
       {r6(_entropy_sql('payload'), 'b_cmd_entropy')}, {_hit(text.WRITABLE, 'img')} AS b_exec_writable
FROM (SELECT *, coalesce({payload_sql('raw')}, '') AS payload, coalesce(raw, '') AS cmd FROM (
    SELECT {KEY}, max(label) AS label, epoch_us(min(UtcTime)) AS s, epoch_us(max(UtcTime)) AS e, {_first('ParentProcessGuid')} AS ParentProcessGuid,
           {_first('Image')} AS img, lower(regexp_extract(coalesce({_first('Image')}, ''), '([^\\\\/]*)$', 1)) AS base, {_first('CommandLine')} AS raw,
           coalesce({_first('ParentCommandLine')}, '') AS pcmd FROM ev GROUP BY {KEY}))
JOIN (SELECT platform, run_id, min(session) AS session FROM ev GROUP BY ALL) USING (platform, run_id)"""


@check("a6_behaviour_features", f"""
SELECT a.*, b.* EXCLUDE (platform, run_id, ProcessGuid, age_ix), d.* EXCLUDE (platform, run_id, ProcessGuid),
       coalesce(b_sib_spawned, 0) AS b_sib_spawned, coalesce(b_sib_same_image, 0) AS b_sib_same_image, coalesce(b_sib_images, 0) AS b_sib_images,
       coalesce(b_sib_period_cv, -1.0) AS b_sib_period_cv, coalesce(b_sib_period_s, -1.0) AS b_sib_period_s
FROM ({SQL['a4_prefix_features']}) a JOIN ({SQL['a5_behaviour_at_age']}) b USING (platform, run_id, ProcessGuid, age_ix)
JOIN ({with_ev(_DESCRIBED)}) d USING (platform, run_id, ProcessGuid)
LEFT JOIN ({SQL['a6_sibling_context']}) s USING (platform, run_id, ProcessGuid, age_ix)
LEFT JOIN ({SQL['a6_sibling_periods']}) q USING (platform, run_id, ProcessGuid, age_ix)""")
def a6_all(spark, sf):
    rows = features.behaviour_features(telemetry_table(spark, sf))
    return rounded(rows.withColumns({c: F.unix_micros(c) for c in ("start", "end")}))
