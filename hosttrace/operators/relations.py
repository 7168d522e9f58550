"""Membership, summaries side by side, first rows, set operations, and orders as positions."""

from functools import reduce

from pyspark.sql import functions as F

from hosttrace.operators.ordered import row_numbers


def membership(df, marked, key, out="seen"):
    """Whether each row's key is among ``marked``. Keys are made distinct first, so no row is repeated."""
    known = marked.select(key, F.lit(True).alias(out)).distinct()
    return df.join(known, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def side_by_side(tables, key):
    """Summary tables with one row per key, joined so that no key of any is lost."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), tables)


def first_rows(events, key, columns, order="record_id"):
    """The given columns of each key's first row."""
    first = events.groupBy(*key).agg(F.min(F.struct(order, *[c for c in columns if c != order])).alias("_f"))
    return first.select(*key, "_f.*")


def only_in_first(first, second, columns):
    """Distinct values of the first table that the second lacks."""
    return first.select(*columns).subtract(second.select(*columns))


def in_both(first, second, columns):
    return first.select(*columns).intersect(second.select(*columns))


def positions(df, order, out="position"):
    """Each row's place in a global order, counted in chunks so that no task holds the table.

    ``order`` maps helper columns to ascending sort keys; keys must not be NULL (see ``descending_nulls_last``).
    """
    named = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    return row_numbers(named, [], [f"_o{i}" for i in range(len(order))], out).select(*df.columns, out)


def descending_nulls_last(score):
    """Two ascending keys for "largest first, missing last"."""
    return [score.isNull(), F.coalesce(-score, F.lit(0.0))]


def top(df, order, n):
    """The first ``n`` rows of an order; each task passes on at most ``n``."""
    return df.orderBy(*order).limit(n)


def packed_top(df, group, order, value, n, separator="|"):
    """Per group the first ``n`` values of an order as one text."""
    from hosttrace.operators.splits import top_per_group
    rows = top_per_group(df, group, order, n)
    packed = F.array_sort(F.collect_list(F.struct("rank", F.col(value).cast("string").alias("v"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(packed, lambda s: s["v"]), separator).alias("top"))
