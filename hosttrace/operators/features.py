"""Event rows to process rows: whole-life features, features as of an age, behaviour and sibling context."""

from functools import reduce

from pyspark.sql import functions as F

from hosttrace.functions.rules import TACTIC_NAMES, evidence_rule, harness_mask, tactic, technique_of
from hosttrace.functions.text import (basename, command_structure, entropy, extension, external_ip, flag, last_part,
                                      scenario, sensitive, unwrap_command)
from hosttrace.operators.clean import drop_unkeyed, has_guid
from hosttrace.operators.ordered import lag_of, lookup_prefix
from hosttrace.schema import FEATURE_EVENT_IDS, PROCESS_FEATURES, PROCESS_KEY

ORDER = ("record_id",)  # the log's own sequence number: what "first" means below
DISTINCT = {"n_files": "TargetFilename", "n_dst_ip": "DestinationIp", "n_dst_port": "DestinationPort",
            "n_regobj": "TargetObject", "n_device": "Device"}
AGES = [0.0, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 300.0, float("inf")]  # seconds after the first event (fixed values)
WHOLE = len(AGES) - 1
_UNDATED = len(AGES)  # bin of events without a readable time: counted at no age
_LONGEST_S = 10_000_000  # how far "infinite" age looks back for siblings (fixed value): 116 days
SHARES = 64  # into which the events of one process are dealt
PER_TASK = 100_000  # events whose processes are brought to their ages in one task


def _ordering(order):
    """What "first" means: the sequence number, and the time where a row has none; last come rows with neither.

    One number of fixed width, so that aggregates on it stay hash aggregates.
    """
    if tuple(order) == ORDER:
        return F.coalesce(F.col("record_id").cast("long"), F.unix_micros("UtcTime"), F.lit(2**63 - 1))
    return F.struct(*order)


def first_value(value, order=ORDER):
    """Value of the first row, in log order, where it is not NULL."""
    return F.min_by(value, F.when(value.isNotNull(), _ordering(order)))


def _seconds(later, earlier):
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def _finish(df, keep):
    """Shares, rate and zero-filled doubles from the counted columns."""
    n = F.col("n_events").cast("double")
    dur = F.coalesce(F.col("dur_s"), F.lit(0.0))
    derived = {f"frac_{e}": F.coalesce(F.try_divide(F.col(f"ev_{e}"), n), F.lit(0.0)) for e in FEATURE_EVENT_IDS}
    derived["rate"] = n / F.greatest(dur, F.lit(1.0))
    return df.select(*keep, *[
        F.coalesce(derived.get(c, F.col(c) if c in df.columns else F.lit(0)), F.lit(0)).cast("double").alias(c)
        for c in PROCESS_FEATURES])


def _whole_life(order):
    """Aggregates with fixed-width buffers only, so the plan stays a hash aggregate on both sides of the shuffle."""
    return [
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(F.col("EventID") == e).alias(f"ev_{e}") for e in FEATURE_EVENT_IDS],
        _seconds(F.max("UtcTime"), F.min("UtcTime")).alias("dur_s"),
        first_value(F.length("CommandLine"), order).alias("cmd_len"),
        first_value(F.length("ParentCommandLine"), order).alias("pcmd_len"),
        F.max("label").alias("label"),
    ]


def distinct_counts(events, key):
    """Distinct values per key and column: non-NULL values in long form, deduplicated before they meet their key.

    The two steps shuffle on (key, column, value) first, so neither a hot process nor its values gather in one task,
    and an event costs one row per value it has rather than one per counted column.
    """
    items = [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("tag"), F.col(c).cast("string").alias("value")))
             for i, c in enumerate(DISTINCT.values())]
    values = events.select(*key, F.explode(F.array_compact(F.array(*items))).alias("i")).select(
        *key, "i.tag", "i.value").distinct()
    return values.groupBy(*key).agg(*[F.count_if(F.col("tag") == i).alias(n) for i, n in enumerate(DISTINCT)])


def process_features(events, key=PROCESS_KEY, order=ORDER):
    """32 features and the label per process.

    One hash aggregation on the process key, joined to the distinct counts, which arrive partitioned by the same key.
    """
    e = drop_unkeyed(events)
    grouped = e.groupBy(*key).agg(*_whole_life(order)).join(distinct_counts(e, key), list(key), "left")
    return _finish(grouped, [*key, "label"])


def run_sessions(events):
    """(platform, run_id) -> session, scenario. A run is one recording, so it has one session."""
    pairs = events.select("platform", "run_id", "session").distinct()
    runs = pairs.groupBy("platform", "run_id").agg(F.min("session").alias("session"))
    return runs.withColumn("scenario", scenario(F.col("session")))


def process_parents(events, key=PROCESS_KEY, order=ORDER):
    """First logged parent id per process. Distinct pairs come first, so the text columns shuffle once per pair."""
    pairs = (drop_unkeyed(events).where(has_guid(F.col("ParentProcessGuid")))
             .groupBy(*key, "ParentProcessGuid").agg(F.min(_ordering(order)).alias("_o")))
    return pairs.groupBy(*key).agg(F.min_by("ParentProcessGuid", "_o").alias("ParentProcessGuid"))


def process_meta(events, key=PROCESS_KEY, order=ORDER):
    """Descriptive columns per process: parent, start and end, first image and commands, harness mark, session."""
    image, cmd, parent_cmd = F.col("Image"), F.col("CommandLine"), F.col("ParentCommandLine")
    meta = drop_unkeyed(events).groupBy(*key).agg(
        F.min("UtcTime").alias("start"), F.max("UtcTime").alias("end"), F.max("label").alias("label"),
        first_value(F.col("ParentProcessGuid"), order).alias("ParentProcessGuid"),
        first_value(image, order).alias("Image"), first_value(cmd, order).alias("CommandLine"),
        first_value(parent_cmd, order).alias("ParentCommandLine"))
    meta = meta.withColumn("harness", harness_mask(image, cmd, parent_cmd))
    return meta.join(run_sessions(events), ["platform", "run_id"], "left")


def guid_only_features(events, order=ORDER):
    """The earlier 35-feature variant keyed by ProcessGuid alone, with image length, depth and enrichment flags."""
    e = events.where(F.col("ProcessGuid").isNotNull())
    extra = [first_value(F.length("Image"), order).alias("img_len"), F.max("ancestor_depth").alias("depth"),
             F.max("enriched").alias("enriched"), F.count_distinct("run_id").alias("n_runs")]
    grouped = e.groupBy("ProcessGuid").agg(*_whole_life(order), *extra).join(
        distinct_counts(e, ["ProcessGuid"]), "ProcessGuid", "left")
    return _finish(grouped.fillna(0, ["img_len", "depth", "enriched"]),
                   ["ProcessGuid", "label", "n_runs", "img_len", "depth", "enriched"])


def vocabulary_features(events, key=PROCESS_KEY):
    """Counts and shares for whichever event ids occur. The vocabulary is the sensor's, a few dozen ids at most."""
    e = drop_unkeyed(events)
    ids = sorted(r[0] for r in e.select("EventID").where("EventID IS NOT NULL").distinct().collect())
    counts = e.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(F.col("EventID") == i).alias(f"ev_{i}") for i in ids])
    return counts.select(*key, "n_events", *[f"ev_{i}" for i in ids],
                         *[(F.col(f"ev_{i}") / F.col("n_events")).alias(f"frac_{i}") for i in ids])


# --- features as of an age ----------------------------------------------------------------------------------------

def age_bin(age):
    """Index of the smallest age limit that covers ``age`` seconds; NULL age falls in no bin."""
    out = F.when(age.isNull(), _UNDATED)
    for i, limit in enumerate(AGES[:-1]):
        out = out.when(age <= limit, i)
    return out.otherwise(WHOLE)


def _aged(events, key):
    """Events with their process start and age bin.

    Start comes from an aggregate plus an equi-join. The rows are then dealt by process and a share of its events: with
    that exchange in place adaptive execution may split a hot process in the join, and what follows adds up each share
    before the shares of a process meet.
    """
    starts = events.groupBy(*key).agg(F.min("UtcTime").alias("start"))
    share = F.pmod(F.xxhash64("record_id", "UtcTime", "EventID"), F.lit(SHARES))
    joined = events.join(starts, list(key)).repartition(*[F.col(c) for c in key], share)
    return joined.withColumn("bin", age_bin(_seconds(F.col("UtcTime"), F.col("start")))), starts


def _first_bins(tagged, key):
    """Rows (key, tag, value, bin, deleted) -> per bin, how many values of each tag were first seen in it.

    For the tag `churn` a value counts once it has been both created and deleted."""
    seen = tagged.groupBy(*key, "tag", "value").agg(
        F.min(F.when(~F.col("deleted"), F.col("bin"))).alias("made"),
        F.min(F.when(F.col("deleted"), F.col("bin"))).alias("gone"))
    both = F.when(F.col("gone").isNotNull() & F.col("made").isNotNull(), F.greatest("made", "gone"))
    first = F.when(F.col("tag") == "b_create_then_delete", both).otherwise(F.col("made"))
    tags = [*DISTINCT, "b_n_ext", "b_create_then_delete"]
    return (seen.withColumn("bin", first).where("bin IS NOT NULL").groupBy(*key, "bin")
            .agg(*[F.count_if(F.col("tag") == t).alias(t) for t in tags]))


def _tagged_values(events, key):
    """Distinct-count inputs in long form; NULLs never leave the scan stage."""
    target = F.col("TargetFilename")
    named = target.isNotNull() & (target != "")

    def item(condition, tag, value, deleted=F.lit(False)):
        return F.when(condition, F.struct(F.lit(tag).alias("tag"), value.cast("string").alias("value"),
                                          deleted.alias("deleted")))

    items = [item(F.col(c).isNotNull(), n, F.col(c)) for n, c in DISTINCT.items()]
    items.append(item((F.col("EventID") == 11) & named & extension(target).isNotNull(), "b_n_ext", extension(target)))
    items.append(item(F.col("EventID").isin(11, 23) & named, "b_create_then_delete", F.lower(target),
                      F.col("EventID") == 23))
    return (events.where(F.col("bin") < _UNDATED)
            .select(*key, "bin", F.explode(F.array_compact(F.array(*items))).alias("i"))
            .select(*key, "bin", "i.tag", "i.value", "i.deleted"))


def _children(events, starts, key):
    """Creations per age bin of the parent, attributed to the parent process."""
    parent = [*key[:-1], "ParentProcessGuid"]
    born = (events.where((F.col("EventID") == 1) & has_guid(F.col("ParentProcessGuid")))
            .select(*parent, F.col("UtcTime").alias("born")))
    joined = born.withColumnRenamed("ParentProcessGuid", key[-1]).join(starts, list(key))
    aged = joined.withColumn("bin", age_bin(_seconds(F.col("born"), F.col("start")))).where(F.col("bin") < _UNDATED)
    return aged.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("b_children"))


def age_tasks(events):
    return max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // PER_TASK))


def prefix_features(events, key=PROCESS_KEY, order=ORDER, behaviour=True):
    """Features of every process at every age limit, one row per (process, age_ix).

    Events are not copied per age. They collapse to (process, age bin) first, at most one row per bin, and only that
    small table fans out to the ages that include the bin.
    """
    source = drop_unkeyed(events)
    # Commands are long and only their length counts: it is taken before the rows are shuffled and sorted.
    e, starts = _aged(source.withColumns({"_cmd": F.length(unwrap_command(F.col("CommandLine"))),
                                          "_pcmd": F.length(unwrap_command(F.col("ParentCommandLine")))}), key)
    dated = F.col("bin") < _UNDATED
    micros, ordering = F.unix_micros("UtcTime"), _ordering(order)
    target = F.col("TargetFilename")
    created = (F.col("EventID") == 11) & (target != "")
    name_entropy = F.when(created, entropy(last_part(target)))
    additive = {
        "n_events": F.count_if(dated),
        **{f"ev_{i}": F.count_if(dated & (F.col("EventID") == i)) for i in FEATURE_EVENT_IDS},
    }
    if behaviour:
        additive.update({
            "b_sensitive": F.count_if(dated & sensitive(target, F.col("TargetObject"))),
            "b_ext_conn": F.count_if(dated & (F.col("EventID") == 3) & external_ip(F.col("DestinationIp"))),
            "_ent_n": F.count(F.when(dated, name_entropy)), "_ent_sum": F.sum(F.when(dated, name_entropy)),
        })
    lows = {"_t0": F.min(F.when(dated, micros)),
            "_cmd_o": F.min(F.when(dated & F.col("_cmd").isNotNull(), ordering)),
            "_pcmd_o": F.min(F.when(dated & F.col("_pcmd").isNotNull(), ordering))}
    highs = {"_t1": F.max(F.when(dated, micros))}
    if behaviour:
        highs["_ent_max"] = F.max(F.when(dated, name_entropy))
    firsts = {"_cmd_v": F.min_by("_cmd", F.when(dated & F.col("_cmd").isNotNull(), ordering)),
              "_pcmd_v": F.min_by("_pcmd", F.when(dated & F.col("_pcmd").isNotNull(), ordering))}
    counted = e.groupBy(*key, "bin").agg(
        *[c.alias(n) for n, c in {**additive, **lows, **highs, **firsts}.items()])
    parts = [counted, _first_bins(_tagged_values(e, key), key)]
    if behaviour:
        parts.append(_children(source, starts, key))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # Nine rows a process are the widest step. Tasks grow in number with the events, not in size; a process has a row for
    # each bin and part at most, so none is hot.
    merged = merged.repartition(age_tasks(source), *key)

    spread = F.when(F.col("bin") == _UNDATED, F.sequence(F.lit(0), F.lit(WHOLE))).otherwise(
        F.sequence("bin", F.lit(WHOLE)))
    sums = [*additive, *DISTINCT] + (["b_n_ext", "b_create_then_delete", "b_children"] if behaviour else [])
    by_age = merged.withColumn("age_ix", F.explode(spread)).groupBy(*key, "age_ix").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        ((F.max("_t1") - F.min("_t0")) / F.lit(1e6)).alias("dur_s"),
        F.min_by("_cmd_v", "_cmd_o").alias("cmd_len"), F.min_by("_pcmd_v", "_pcmd_o").alias("pcmd_len"),
        *([F.max("_ent_max").alias("b_fname_ent_max")] if behaviour else []))
    keep = [*key, "age_ix"]
    if behaviour:
        mean = F.try_divide(F.col("_ent_sum"), F.col("_ent_n"))
        by_age = by_age.withColumns({"b_fname_ent_mean": F.coalesce(mean, F.lit(0.0)),
                                     "b_fname_ent_max": F.coalesce("b_fname_ent_max", F.lit(0.0))})
        keep += ["b_sensitive", "b_fname_ent_mean", "b_fname_ent_max", "b_n_ext", "b_ext_conn",
                 "b_create_then_delete", "b_children"]
    return _finish(by_age, keep)


def sibling_context(processes, key=PROCESS_KEY):
    """What a process's parent had spawned by (own start + age), one row per (process with a parent, age_ix).

    ``processes`` needs the key, ParentProcessGuid, Image and start. Counts are running sums at looked-up times, so
    a parent with a very large number of children spreads over many tasks and no sibling pairs are formed. Gaps are
    whole milliseconds and their sums exact.
    """
    parent = [*key[:-1], "parent"]
    p = (processes.where(has_guid(F.col("ParentProcessGuid")) & F.col("start").isNotNull())
         .select(*key, F.col("ParentProcessGuid").alias("parent"),
                 F.coalesce(basename(F.col("Image")), F.lit("")).alias("img"), F.unix_micros("start").alias("at")))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    spawned = p.select(*parent, "at", one.alias("one"), none.alias("new_image"))
    images = p.groupBy(*parent, "img").agg(F.min("at").alias("at")).select(
        *parent, "at", none.alias("one"), one.alias("new_image"))
    limits = F.array(*[F.struct(F.lit(i).alias("age_ix"), F.lit(int(min(a, _LONGEST_S) * 1e6)).alias("plus"))
                       for i, a in enumerate(AGES)])
    queries = p.select("*", F.explode(limits).alias("l")).select(
        *key, "parent", "img", "l.age_ix", (F.col("at") + F.col("l.plus")).alias("at"))
    seen = lookup_prefix(spawned.unionByName(images), queries, parent, "at",
                         sums={"b_sib_spawned": "one", "b_sib_images": "new_image"})

    gaps = lag_of(p, [*parent, "img"], ["at", key[-1]], "at", "prev").withColumn(
        "gap", F.coalesce(F.floor((F.col("at") - F.col("prev")) / 1000), F.lit(0)).cast("decimal(19,0)"))
    points = gaps.select(*parent, "img", "at", one.alias("one"), F.col("gap"),
                         (F.col("gap") * F.col("gap")).cast("decimal(38,0)").alias("gap2"))
    same = lookup_prefix(points, seen, [*parent, "img"], "at",
                         sums={"b_sib_same_image": "one", "_gap": "gap", "_gap2": "gap2"})
    n = (F.col("b_sib_same_image") - 1).cast("double")
    total, squares = F.col("_gap").cast("double"), F.col("_gap2").cast("double")
    mean = total / n
    sd = F.sqrt(F.greatest(n * squares - total * total, F.lit(0.0))) / n
    enough = F.col("b_sib_same_image") >= 3
    return same.select(
        *key, "age_ix", "b_sib_spawned", "b_sib_same_image", "b_sib_images",
        F.when(~enough, -1.0).when(mean > 0, sd / mean).otherwise(0.0).alias("b_sib_period_cv"),
        F.when(enough, mean / 1000).otherwise(-1.0).alias("b_sib_period_s"))


def behaviour_features(events, key=PROCESS_KEY, order=ORDER, whole_only=False):
    """All 53 features per (process, age_ix), joined with the harness mark, label, session and start."""
    meta = process_meta(events, key, order)
    prefix = prefix_features(events, key, order)
    siblings = sibling_context(meta, key)
    if whole_only:
        prefix, siblings = prefix.where(F.col("age_ix") == WHOLE), siblings.where(F.col("age_ix") == WHOLE)
    structure = command_structure(F.col("payload"), F.col("Image"))
    described = meta.withColumn("payload", unwrap_command(F.col("CommandLine"))).select(*key, "label", "session", "scenario", "harness", "start", "end", "ParentProcessGuid",
                            *[c.cast("double").alias(n) for n, c in structure.items()])
    joined = prefix.join(described, list(key), "left").join(siblings, [*key, "age_ix"], "left")
    return joined.fillna(-1.0, ["b_sib_period_cv", "b_sib_period_s"]).fillna(
        0, ["b_sib_spawned", "b_sib_same_image", "b_sib_images"])


def tactic_counts(events, key=PROCESS_KEY):
    """Per process, how many events carry direct evidence of each tactic."""
    found = drop_unkeyed(events).withColumn("_rule", evidence_rule(["DIRECT"])).where("_rule IS NOT NULL")
    named = found.select(*key, tactic(technique_of(F.col("_rule"))).alias("_t"))
    return named.groupBy(*key).agg(*[F.count_if(F.col("_t") == n).alias("t_" + n) for n in TACTIC_NAMES])
