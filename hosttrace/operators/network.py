"""Network flows joined to host events, and what each process did on the network."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hosttrace.functions.numeric import number_or
from hosttrace.functions.text import entropy, first_label, outside_lab_ip
from hosttrace.operators.flow_match import CLUSTER, contested
from hosttrace.operators.ordered import lag_of, quantiles, running
from hosttrace.session import materialize

WINDOW_S = 3.0
_LAST = 2**63 - 1  # log order of events without a record number
MIN_HITS = 4          # per destination
MIN_HITS_OVERALL = 3  # all destinations of the process together
SET_CHARS = 200       # of the joined user agents and server names (fixed value)

# Side-log columns attached to a connection, by log (fixed values).
SIDE_COLUMNS = {
    "dns": ["query", "qtype_name", "rcode_name", "answers"],
    "http": ["method", "host", "uri", "user_agent", "status_code", "request_body_len", "response_body_len"],
    "ssl": ["server_name", "version", "cipher", "established"],
    "files": ["mime_type", "filename", "total_bytes", "md5"],
}
# Flow columns carried by a fused event (fixed values).
ATTACHED = [
    "uid", "proto", "service", "duration", "orig_bytes", "resp_bytes", "conn_state", "orig_pkts", "resp_pkts",
    "dns_query", "dns_qtype_name", "dns_answers", "http_method", "http_host", "http_uri", "http_user_agent",
    "http_status_code", "ssl_server_name", "ssl_version", "files_mime_type", "files_filename",
]


def attach_side_logs(conn, logs, line="line_no"):
    """Left-join dns / http / ssl / files rows by uid; per column the first non-empty value in line order."""
    for name, log in logs.items():
        present = [c for c in SIDE_COLUMNS[name] if c in log.columns]
        first = log.where(F.coalesce("uid", F.lit("")) != "").groupBy("uid").agg(*[
            F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(line)))
            .alias(f"{name}_{c}") for c in present])
        conn = conn.join(first, "uid", "left")
    return conn


def flow_key(source_ip, source_port, dest_ip, dest_port, proto):
    parts = [source_ip, source_port, dest_ip, dest_port, F.lower(proto)]
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def keyed_events(events):
    """Connection events with their flow key and time in epoch seconds."""
    c = F.col
    return events.where(c("EventID") == 3).withColumns({
        "fkey": flow_key(c("SourceIp"), c("SourcePort"), c("DestinationIp"), c("DestinationPort"), c("Protocol")),
        "ts": F.unix_micros("UtcTime") / F.lit(1e6)})


def keyed_flows(flows):
    c = F.col
    return flows.withColumn("fkey", flow_key(c("orig_h"), c("orig_p"), c("resp_h"), c("resp_p"), c("proto")))


def clock_offset(events, flows):
    """Per session: median of flow time minus event time over keys with exactly one flow and one event.

    A session without such a key has offset 0 from 0 pairs.
    """
    one = F.count(F.lit(1))
    ev = events.where("ts IS NOT NULL").groupBy("session", "fkey").agg(one.alias("n"), F.min("ts").alias("ev_ts"))
    fl = flows.groupBy("session", "fkey").agg(one.alias("m"), F.min("ts").alias("fl_ts"))
    pairs = ev.where("n = 1").join(fl.where("m = 1"), ["session", "fkey"]).select(
        "session", (F.col("fl_ts") - F.col("ev_ts")).alias("delta"))
    pairs = materialize(pairs, "offsets")
    found = quantiles(pairs, ["session"], "delta", 0.5, "offset").join(
        pairs.groupBy("session").agg(one.alias("offset_n")), "session")
    sessions = events.select("session").unionByName(flows.select("session")).where("session IS NOT NULL").distinct()
    return sessions.join(found, "session", "left").fillna({"offset": 0.0, "offset_n": 0})


def _single_sided(live, window):
    """Clusters with one event or one flow need no rounds and stay in the JVM."""
    gap = F.abs(F.col("t") - F.col("ev.t"))
    one_event = live.where("kind = 0 AND n_ev = 1").groupBy(*CLUSTER).agg(
        F.min(F.struct(gap.alias("d"), "t", "uid")).alias("b"), F.max("ev.id").alias("id")).select(
        *CLUSTER, "id", F.col("b.uid").alias("flow"), F.col("b.d").alias("dt"))
    gap = F.abs(F.col("t") - F.col("fl.t"))
    one_flow = live.where("kind = 1 AND n_fl = 1 AND n_ev > 1").where(gap <= window).groupBy(*CLUSTER).agg(
        F.min(F.struct("id", "t", gap.alias("d"))).alias("b"), F.max("fl.uid").alias("flow")).select(
        *CLUSTER, F.col("b.id").alias("id"), "flow", F.col("b.d").alias("dt"))
    return one_event.unionByName(one_flow).where(F.col("dt") <= window)


def match_flows(events, flows, offsets=None, window=WINDOW_S, slice_rows=50_000):
    """One-to-one matches (session, record_id, uid, dt): each event, in log order, takes the nearest free flow.

    Only points less than ``window`` apart can compete, so every key splits into clusters at larger gaps and the
    clusters match independently; those with one event or one flow are a plain aggregate. The others go through
    ``flow_match``, in slices of about ``slice_rows`` flows side by side. An event without a time takes the first free
    flow of its key whatever the window (dt NULL), so keys with such events stay whole. Of equally near flows the
    earlier one goes first, then the smaller uid. Events without a record_id come last; flows without a time stand at 0.
    """
    if offsets is not None:
        events = events.join(offsets.select("session", "offset"), "session", "left")
    shift = F.coalesce("offset", F.lit(0.0)) if offsets is not None else F.lit(0.0)
    ev = events.select("session", "fkey", F.lit(1).alias("kind"),
                       F.coalesce(F.col("record_id").cast("long"), F.lit(_LAST)).alias("id"), (F.col("ts") + shift).alias("t"))
    fl = flows.select("session", "fkey", F.lit(0).alias("kind"), "uid", F.coalesce("ts", F.lit(0.0)).alias("t"))
    order = ["t", "kind", "id", "uid"]
    points = ev.where("t IS NOT NULL").withColumn("uid", F.lit("")).unionByName(fl.withColumn("id", F.lit(_LAST)))
    spaced = lag_of(points, ["session", "fkey"], order, "t", "prev")
    cut = F.when(F.col("t") - F.col("prev") <= window, 0).otherwise(1).cast("long")
    untimed = ev.where("t IS NULL").select("session", "fkey", "id").where("session IS NOT NULL AND fkey IS NOT NULL")
    late = None if untimed.isEmpty() else untimed.groupBy("session", "fkey").agg(F.count(F.lit(1)).alias("late"))
    if late is not None:
        spaced = spaced.join(late, ["session", "fkey"], "left")
        cut = F.when(F.col("late").isNull(), cut).otherwise(0)
    clustered = running(spaced.withColumn("_cut", cut.cast("long")), ["session", "fkey"], order, sums={"cluster": "_cut"})
    kinds = clustered.groupBy(*CLUSTER).agg(
        F.count_if(F.col("kind") == 1).alias("n_ev"), F.count_if(F.col("kind") == 0).alias("n_fl"),
        F.min(F.when(F.col("kind") == 1, F.struct("id", "t"))).alias("ev"),
        F.min(F.when(F.col("kind") == 0, F.struct("t", "uid"))).alias("fl"))
    kinds = kinds.withColumn("late", F.lit(0)) if late is None else kinds.join(
        late, ["session", "fkey"], "left").fillna(0, ["late"])
    live = clustered.drop("late").join(kinds.where("n_ev + late > 0 AND n_fl > 0"), CLUSTER)
    live = materialize(live.select(*CLUSTER, "kind", "id", "uid", "t", "n_ev", "n_fl", "late", "ev", "fl"), "clusters")
    found = _single_sided(live.where("late = 0"), window)
    several = live.where("late > 0 OR (n_ev > 1 AND n_fl > 1)")
    if not several.isEmpty():
        ev = several.where("kind = 1").select(*CLUSTER, "id", "t", F.lit(float(window)).alias("reach"))
        if late is not None:
            whole = several.where("late > 0").select(*CLUSTER).distinct()
            ev = ev.unionByName(untimed.join(whole, ["session", "fkey"]).select(
                *CLUSTER, "id", F.lit(None).cast("double").alias("t"), F.lit(float("inf")).alias("reach")))
        fl = several.where("kind = 0").select(*CLUSTER, F.col("uid").alias("id"), "t")
        found = found.unionByName(contested(ev, fl, slice_rows))
    return found.select("session", F.when(F.col("id") != _LAST, F.col("id")).alias("record_id"), F.col("flow").alias("uid"), "dt")


def nearest_flow(events, flows, window=WINDOW_S):
    """Nearest flow per event within the window, flows may be shared: the non-greedy variant.

    Both neighbours come from running maxima over the merged timeline, so no event-flow pairs are formed.
    """
    keys = ["session", "fkey"]
    ev = events.where("ts IS NOT NULL").select(*keys, F.col("record_id"), F.col("ts").alias("at"))
    fl = flows.select(*keys, "uid", F.col("ts").alias("at"))

    def neighbour(sign, out):
        points = fl.withColumn("at", sign * F.col("at")).withColumn("hit", F.struct("at", "uid"))
        queries = ev.withColumn("at", sign * F.col("at"))
        merged = points.select(*keys, "at", "hit").withColumn("_query", F.lit(0)).unionByName(
            queries.withColumn("_query", F.lit(1)), allowMissingColumns=True)
        found = running(merged, keys, ["at", "_query"], maxes={"hit_": "hit"}).where("_query = 1")
        return found.select("session", "record_id", F.abs(F.col("at") - F.col("hit_.at")).alias(out + "_dt"),
                            F.col("hit_.uid").alias(out))

    both = neighbour(1, "before").join(neighbour(-1, "after"), ["session", "record_id"])
    earlier = F.coalesce(F.col("before_dt") <= F.coalesce("after_dt", F.lit(float("inf"))), F.lit(False))
    return both.select("session", "record_id", F.when(earlier, F.col("before")).otherwise(F.col("after")).alias("uid"),
                       F.when(earlier, F.col("before_dt")).otherwise(F.col("after_dt")).alias("dt")).where(
        F.col("dt") <= window)


def fuse(events, flows, pairs):
    """Every connection event with its flow's columns (NULL when unmatched) and the time difference."""
    attach = flows.select("session", "uid", *[F.col(c).alias("flow_" + c) for c in ATTACHED if c in flows.columns])
    return events.join(pairs, ["session", "record_id"], "left").join(attach, ["session", "uid"], "left")


def match_summary(events, flows, pairs):
    """Per session: events, flows, matches, match rate in percent, and what stayed alone on either side."""
    ev = events.groupBy("session").agg(F.count(F.lit(1)).alias("events"))
    fl = flows.groupBy("session").agg(F.count(F.lit(1)).alias("flows"))
    hit = pairs.groupBy("session").agg(F.count(F.lit(1)).alias("matched"))
    orphan = flows.join(pairs.select("session", "uid"), ["session", "uid"], "left_anti").groupBy("session").agg(
        F.count(F.lit(1)).alias("orphan_flows"))
    out = ev.join(fl, "session", "full_outer").join(hit, "session", "left").join(orphan, "session", "left").fillna(0)
    return out.select(
        "session", "events", "flows", "matched", (F.col("events") - F.col("matched")).alias("unmatched_events"),
        "orphan_flows", F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("events")), F.lit(0.0))
        .alias("match_rate"))


def _joined_set(fused, keys, column, out, chars=None):
    """Sorted distinct values as `a|b`, cut to ``chars`` characters if given.

    In a cut text only the first ``chars`` values can show, so only they are kept. Uncut sets are of services and
    connection states, whose values are few by nature.
    """
    values = fused.where(F.coalesce(column, F.lit("")) != "").select(*keys, column.alias("_v")).distinct()
    if chars is not None:
        values = values.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))).where(
            F.col("_r") <= chars)
    text = F.array_join(F.sort_array(F.collect_list("_v")), "|")
    return values.groupBy(*keys).agg((text if chars is None else F.substring(text, 1, chars)).alias(out))


def beacon_regularity(events, keys=("session", "ProcessGuid")):
    """Most regular destination per process: fewest relative deviations between consecutive connection times.

    Destinations need MIN_HITS connections. A process without one is measured over all destinations together.
    """
    keys = list(keys)
    dst = F.concat(F.coalesce("DestinationIp", F.lit("")), F.lit(":"),
                   F.coalesce(F.col("DestinationPort").cast("string"), F.lit("")))
    times = events.where("UtcTime IS NOT NULL").select(
        *keys, dst.alias("dst"), F.unix_micros("UtcTime").alias("at"), "record_id")

    def spacing(group):
        gaps = lag_of(times, group, ["at", "record_id"], "at", "prev").withColumn(
            "gap", (F.col("at") - F.col("prev")).cast("decimal(19,0)"))
        stats = gaps.groupBy(*group).agg(
            F.count(F.lit(1)).alias("n"), F.sum("gap").cast("double").alias("total"),
            F.sum((F.col("gap") * F.col("gap")).cast("decimal(38,0)")).cast("double").alias("squares"))
        m = (F.col("n") - 1).cast("double")
        mean, sd = F.col("total") / m, F.sqrt(F.greatest(m * F.col("squares") - F.col("total") ** 2, F.lit(0.0))) / m
        return stats.where((F.col("n") >= MIN_HITS_OVERALL) & (F.col("total") > 0)).select(
            *group, "n", (mean / 1e6).alias("mean_s"), (sd / 1e6).alias("sd_s"), (sd / mean).alias("cv"))

    per_dst = spacing([*keys, "dst"]).where(F.col("n") >= MIN_HITS)
    best = per_dst.groupBy(*keys).agg(F.min(F.struct("cv", "dst", "n", "mean_s", "sd_s")).alias("b")).select(
        *keys, "b.*")
    counts = times.groupBy(*keys).agg(F.count(F.lit(1)).alias("all_n"))
    overall = spacing(keys).select(*keys, F.col("mean_s").alias("all_mean"), F.col("sd_s").alias("all_sd"),
                                   F.col("cv").alias("all_cv"))
    found = F.col("n").isNotNull()
    return counts.join(best, keys, "left").join(overall, keys, "left").select(
        *keys, F.when(found, F.col("n")).otherwise(F.col("all_n")).alias("beacon_n"),
        F.round(F.when(found, F.col("mean_s")).otherwise(F.col("all_mean")), 3).alias("beacon_mean_s"),
        F.round(F.when(found, F.col("sd_s")).otherwise(F.col("all_sd")), 3).alias("beacon_sd_s"),
        F.round(F.when(found, F.col("cv")).otherwise(F.col("all_cv")), 4).alias("beacon_cv"),
        F.coalesce("dst", F.lit("")).alias("beacon_dst"))


def process_network(fused, keys=("session", "ProcessGuid")):
    """The 28-column network table per process from fused events (see ``fuse``)."""
    keys = list(keys)
    fused = fused.withColumn("ProcessGuid", F.coalesce("ProcessGuid", F.lit("")))
    have = set(fused.columns)

    def flow(name):
        return F.col("flow_" + name) if "flow_" + name in have else F.lit(None).cast("string")

    def filled(c):
        return F.coalesce(c.cast("string"), F.lit("")) != ""

    matched = F.col("uid").isNotNull()
    dst, query = F.coalesce("DestinationIp", F.lit("")), flow("dns_query")
    http = filled(flow("http_host")) | filled(flow("http_uri"))
    first = F.min_by(F.struct("Image", "User", "label"),
                     F.struct(F.when(matched, 0).otherwise(1), F.col("record_id")))
    main = fused.groupBy(*keys).agg(
        first.alias("_f"), F.count(F.lit(1)).alias("flow_n"), F.count_if(matched).alias("flow_matched"),
        F.count_distinct(dst).alias("dst_ip_n"),
        F.count_distinct(F.coalesce(F.col("DestinationPort").cast("string"), F.lit(""))).alias("dst_port_n"),
        F.sum(number_or(flow("orig_bytes"))).cast("long").alias("bytes_sent"),
        F.sum(number_or(flow("resp_bytes"))).cast("long").alias("bytes_recv"),
        F.round(F.sum(number_or(flow("duration"))), 3).alias("dur_total_s"),
        F.round(F.max(number_or(flow("duration"))), 3).alias("dur_max_s"),
        F.count_distinct(F.when(outside_lab_ip(dst), dst)).alias("ext_dst_n"),
        F.count_if(filled(query)).alias("dns_n"),
        F.coalesce(F.max(F.length(query)), F.lit(0)).alias("dns_qlen_max"),
        F.round(F.coalesce(F.max(F.when(filled(query), entropy(first_label(query)))), F.lit(0.0)), 3)
        .alias("dns_ent_max"),
        F.count_if(http).alias("http_n"), F.count_if(filled(flow("ssl_server_name"))).alias("ssl_n"))
    out = main.select(*keys, "_f.*", *[c for c in main.columns if c not in {*keys, "_f"}])
    sets = {"svc_set": flow("service"), "conn_state_set": flow("conn_state"),
            "http_ua_set": F.when(http, F.substring(flow("http_user_agent"), 1, 60)),
            "ssl_sni_set": flow("ssl_server_name")}
    for name, column in sets.items():
        chars = SET_CHARS if name in ("http_ua_set", "ssl_sni_set") else None
        out = out.join(_joined_set(fused, keys, column, name, chars), keys, "left")
    out = out.fillna("", list(sets))
    return out.join(beacon_regularity(fused, keys), keys, "left")
