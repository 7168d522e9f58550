"""Fill event rows from the creation record of their process."""

from pyspark.sql import functions as F

from hosttrace.functions.text import flag
from hosttrace.operators.clean import has_guid, process_key
from hosttrace.operators.graph import depth_and_root_image
from hosttrace.schema import INHERIT_COLS, RUN_KEY

_ENTRY = "_entry"
_SPREAD = 1 << 20


def _filled(c):
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""


def creation_records(events, key, order=("record_id",)):
    """Last creation record per key, as a struct. ``key`` is the process id, or the PID for the fallback.

    The fallback is not time-aware: a reused PID resolves to its last creation in the run.
    """
    wanted = [c for c in [*INHERIT_COLS, "Image"] if c in events.columns]
    created = events.where((F.col("EventID") == 1) & F.col(key).isNotNull())
    if key == "ProcessGuid":
        created = created.where(has_guid(F.col(key)))
    return created.groupBy(*RUN_KEY, key).agg(F.max_by(F.struct(*wanted), F.struct(*order)).alias(_ENTRY))


def enrich(events, order=("record_id",), pid_fallback=True):
    """Join each event to its process by id, else by PID, and fill only what the event itself lacks.

    Both build sides hold one row per process; a process with very many events is split by adaptive skew handling
    on the event side.
    """
    inherit = [c for c in INHERIT_COLS if c in events.columns]
    by_guid = creation_records(events, "ProcessGuid", order)
    joined = events.join(by_guid, [*RUN_KEY, "ProcessGuid"], "left")
    entry, method = F.col(_ENTRY), F.when(F.col(_ENTRY).isNotNull(), "guid")
    if pid_fallback:
        by_pid = creation_records(events, "ProcessId", order).withColumnRenamed(_ENTRY, "_by_pid")
        # Only events without a match look up their PID. The others get one of many negative numbers, which no process
        # has, so that they spread over the tasks instead of meeting under one NULL.
        nobody = (-1 - F.pmod(F.xxhash64(*order), F.lit(_SPREAD))).cast(events.schema["ProcessId"].dataType)
        joined = joined.withColumn("_pid", F.coalesce(F.when(F.col(_ENTRY).isNull(), F.col("ProcessId")), nobody)).join(
            by_pid.withColumnRenamed("ProcessId", "_pid"), [*RUN_KEY, "_pid"], "left")
        entry = F.coalesce(F.col(_ENTRY), F.col("_by_pid"))
        method = method.when(F.col("_by_pid").isNotNull(), "pid")
    joined = joined.withColumns({_ENTRY: entry, "_method": method})

    def gains(c):
        return ~_filled(c) & (F.coalesce(F.trim(F.col(f"{_ENTRY}.{c}").cast("string")), F.lit("")) != "")

    any_gain = F.lit(False)
    for c in inherit:
        any_gain = any_gain | gains(c)
    enriched = any_gain & (F.col("EventID") != 1)
    own = {c: F.when(gains(c), F.col(f"{_ENTRY}.{c}")).otherwise(F.col(c)).alias(c) for c in [*inherit, "Image"]}
    return joined.select(
        *[own.get(c, F.col(c)) for c in events.columns],
        flag(enriched).alias("enriched"),
        F.when(enriched, F.col("_method")).otherwise("none").alias("enrich_method"))


def creation_forest(events, order=("record_id",)):
    """One row per created process: composite key, composite parent key, image."""
    created = events.where((F.col("EventID") == 1) & has_guid(F.col("ProcessGuid")))
    last = created.groupBy(*RUN_KEY, "ProcessGuid").agg(
        F.max_by(F.struct("ParentProcessGuid", "Image", "ParentImage"), F.struct(*order)).alias("_e"))
    return (last.select(*RUN_KEY, "ProcessGuid", "_e.*")
            .select(process_key().alias("node"), process_key("ParentProcessGuid").alias("parent"), "Image",
                    "ParentImage"))


def add_lineage(events, order=("record_id",)):
    """Ancestor depth and root image of the event's process; NULL without a creation record."""
    lineage = depth_and_root_image(creation_forest(events, order))
    return events.withColumn("node", process_key()).join(lineage, "node", "left").drop("node")
