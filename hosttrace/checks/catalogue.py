"""All registered queries."""

from functools import wraps

from hosttrace.checks import audits, behaviour, evaluation, features, learning, relations, scalars, storage, streams  # noqa: F401
from hosttrace.checks.registry import QUERIES, SQL


def _in_utc(fn):
    """Event times are UTC, whatever zone the session came with."""
    @wraps(fn)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    return run


def queries():
    return {name: _in_utc(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(SQL)
