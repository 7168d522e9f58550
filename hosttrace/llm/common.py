"""Small helpers that the operators of this package share."""

import ctypes
import gc

import pyarrow as pa

from hosttrace.session import materialize, scratch_dir  # noqa: F401


def table(spark, sf_dir, name):
    """A given table, through Spark's own reader, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark, rows=1000, size=8 << 20):
    """Let Python tasks of this session meet whole texts in batches of bounded rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_tool = {}


def worker_tool(key, make=None):
    """A table that this Python worker keeps from task to task.

    A worker lives through many operators. It holds the table of one at a time: whoever asks for another, or with no
    ``make`` for none, gives the memory of the last back to the machine.
    """
    if key not in _tool:
        if _tool:
            _tool.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # a C library without it
                pass
        if make is None:
            return None
        _tool[key] = make()
    return _tool[key]


def utf8(column):
    """The values of an Arrow string column as bytes; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def texts(column):
    """The values of an Arrow string column as str; null is empty."""
    return ["" if v is None else v for v in column.to_pylist()]


def per_batch(fn):
    """A function for ``mapInArrow`` from a function of one record batch."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return run


def free_name(df, name):
    """``name``, or with underscores if ``df`` has such a column (in any case) already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
