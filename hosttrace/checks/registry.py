"""Registered queries and the SQL that states the same result."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hosttrace.checks.telemetry import EVENTS_SQL, FLOWS_DUCK

QUERIES, SQL = {}, {}

EV = f"ev AS ({EVENTS_SQL})"
FLOWS = f"fl AS ({FLOWS_DUCK})"
NODE = "platform || '|' || run_id || '|' || ProcessGuid"
PARENT = "platform || '|' || run_id || '|' || ParentProcessGuid"
KEY = "platform, run_id, ProcessGuid"


def check(name, sql=None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` under a name, with its SQL if it has one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return add


def with_ev(body, *more):
    """SQL over the telemetry projection; ``more`` are further CTEs."""
    return f"WITH RECURSIVE {', '.join([EV, *more])}\n{body.strip()}"


def rounded(df, digits=6):
    """Doubles to six digits, so that summation order cannot show."""
    return df.select([F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                      else F.col(f.name) for f in df.schema.fields])


def r6(expression, name):
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"
