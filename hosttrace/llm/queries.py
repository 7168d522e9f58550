"""Registered queries of this package: each applies one operator to its whole table."""

from pyspark.sql import functions as F

from hosttrace.llm import (ans_store, counterfactual_toxicity, covering_lsh, host_consensus, length_histogram, orchard_clusters,
                           packing, periodic_runs, pii_anchors, pruned_graph, quality_gate, template_leaks, warc_segments)
from hosttrace.llm.common import materialize, table


def op1_length_histogram(spark, sf_dir):
    counts = materialize(length_histogram.length_counts(table(spark, sf_dir, "documents")), "length-counts")
    return length_histogram.histogram(counts)


def op2_template_leaks(spark, sf_dir):
    return template_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_gate(spark, sf_dir):
    found = quality_gate.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.array_join("rejected_by", ",").alias("rejected_by"))


def op4_counterfactual_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return counterfactual_toxicity.score(docs, counterfactual_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_covering_lsh(spark, sf_dir):
    found = covering_lsh.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", covering_lsh.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_warc_segments(spark, sf_dir):
    return warc_segments.round_trip(table(spark, sf_dir, "pages"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).drop("used")


def op8_pii_anchors(spark, sf_dir):
    return pii_anchors.detect(table(spark, sf_dir, "documents"))


def op9_host_consensus(spark, sf_dir):
    return host_consensus.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_ans_store(spark, sf_dir):
    return ans_store.round_trip(table(spark, sf_dir, "documents"))


def op11_orchard_clusters(spark, sf_dir):
    return orchard_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"))


def op13_pruned_graph(spark, sf_dir):
    return pruned_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


_BITS = "0000000100100011010001010110011110001001101010111100110111101111"
_OP6 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS sha FROM p),
bits AS (SELECT page_id, payload_bytes, sha, array_to_string(list_transform(range(1, 41),
    lambda k: substr('{_BITS}', CAST((instr('0123456789abcdef', substr(sha, CAST(k AS INT), 1)) - 1) * 4 + 1 AS INT), 4)), '') AS b FROM d),
last AS (SELECT sha, max(page_id) AS last FROM d GROUP BY sha)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        16 * CAST(substr(b, CAST(5 * g + 1 AS INT), 1) AS INT) + 8 * CAST(substr(b, CAST(5 * g + 2 AS INT), 1) AS INT)
        + 4 * CAST(substr(b, CAST(5 * g + 3 AS INT), 1) AS INT) + 2 * CAST(substr(b, CAST(5 * g + 4 AS INT), 1) AS INT)
        + CAST(substr(b, CAST(5 * g + 5 AS INT), 1) AS INT) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM bits JOIN last USING (sha)
"""


def _op11(dims=orchard_clusters.DIMS, scale=orchard_clusters.SCALE, centroids=orchard_clusters.CENTROIDS, rounds=orchard_clusters.ROUNDS, seed=orchard_clusters.SEED):
    """Every round as two steps: all distances, then floor means."""
    def nearest(k):
        distance = "list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"a{k} AS MATERIALIZED (SELECT x.r, min(CAST({distance} AS HUGEINT) * {centroids} + y.c) AS m FROM kept x CROSS JOIN c{k} y GROUP BY x.r)"

    def means(k):
        return f"""s{k} AS (SELECT m % {centroids} AS c, p, sum(x.v[p]) AS s, count(*) AS n FROM a{k} JOIN kept x USING (r), unnest(range(1, {dims + 1})) AS t(p) GROUP BY 1, 2),
n{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM s{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT y.c, coalesce(n{k}.v, y.v) AS v FROM c{k} y LEFT JOIN n{k} ON n{k}.c = y.c)"""

    steps = ",\n".join(f"{nearest(k)},\n{means(k)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
ranked AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept),
c0 AS MATERIALIZED (SELECT c, v FROM ranked WHERE c < {centroids}),
{steps},
{nearest(rounds)},
f AS (SELECT vec_id, CAST(m % {centroids} AS INT) AS cluster, CAST(m // {centroids} AS BIGINT) AS distance FROM a{rounds} JOIN kept USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(y.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM f JOIN c{rounds} y ON y.c = f.cluster
"""


def queries():
    return {f.__name__: f for f in (op1_length_histogram, op2_template_leaks, op3_quality_gate, op4_counterfactual_toxicity, op5_covering_lsh,
                                    op6_warc_segments, op7_packing, op8_pii_anchors, op9_host_consensus, op10_ans_store, op11_orchard_clusters, op12_periodic_runs, op13_pruned_graph)}


def oracle_sql():
    return {"op6_warc_segments": _OP6.strip(), "op11_orchard_clusters": _op11().strip()}
