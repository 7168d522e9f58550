"""Where loops cut their lineage: tables written to the shared checkpoint folder."""

import re
import tempfile
import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target

AT_ONCE = 4  # independent jobs that run side by side, as CrossValidator's parallelism


def scratch_dir(spark):
    """The cluster's checkpoint folder; a private temporary one only where driver and tasks are one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hosttrace-"))
    return spark.sparkContext.getCheckpointDir()


_tables = {}


def release(spark):
    """Delete the tables that ``materialize`` has written in this application. Call it once results are written."""
    for path in _tables.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark, name):
    """A new path in the scratch folder, deleted with the tables of this application."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df, name):
    """Write ``df`` once and continue from the written table.

    Unlike a cached or locally checkpointed frame, the table survives the loss of any executor, and unlike
    ``DataFrame.checkpoint`` the work runs once and the columns stay prunable.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark, calls, at_once=AT_ONCE):
    """Results of independent calls in their order, a few at a time: steps too short to fill the cluster share it."""
    calls = [inheritable_thread_target(spark)(call) for call in calls]
    if not calls:
        return []
    with ThreadPool(min(at_once, len(calls))) as pool:
        return pool.map(lambda call: call(), calls, chunksize=1)
