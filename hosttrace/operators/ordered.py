"""Order-dependent work on groups of any size.

A plain window puts each group into one task, so one hot process, parent or run becomes the whole job. Here rows are
range-partitioned on (group, order): a hot group spreads over as many chunks as it needs. Windows run inside
(group, chunk), and only groups that span several chunks need a carry row per chunk. There are at most two such rows
per chunk, so the carry table is bounded by the number of shuffle partitions and is safe to broadcast.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hosttrace.session import materialize

CHUNK = "_chunk"


def running(df, keys, order, sums=None, maxes=None, before=False):
    """Add running sums and maxima along ``order`` inside ``keys``.

    ``sums`` / ``maxes`` map an output column to an input column. The order has to be total where it matters (add a
    tie-break column). ``before=True`` leaves the current row out, so ``maxes`` on the order column is a lag.
    Key and order columns must not be NULL.
    """
    sums, maxes = sums or {}, maxes or {}
    base = (df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
            .withColumn(CHUNK, F.spark_partition_id()))
    base = materialize(base, "ordered")  # fixes the chunk borders for both passes below
    last = -1 if before else 0
    inside = (Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, last))
    prior = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    partial = [F.sum(c).alias(o) for o, c in sums.items()] + [F.max(c).alias(o) for o, c in maxes.items()]
    carry = (base.groupBy(*keys, CHUNK).agg(*partial)
             .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
             .where("_n > 1")
             .select(*keys, CHUNK,
                     *[F.sum(o).over(prior).alias("_c_" + o) for o in sums],
                     *[F.max(o).over(prior).alias("_c_" + o) for o in maxes]))
    local = base.select("*", *[F.sum(c).over(inside).alias(o) for o, c in sums.items()],
                        *[F.max(c).over(inside).alias(o) for o, c in maxes.items()])
    joined = local.join(F.broadcast(carry), [*keys, CHUNK], "left")
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(o), F.lit(0)) + F.coalesce(F.col("_c_" + o), F.lit(0))).alias(o) for o in sums],
        *[F.greatest(F.col(o), F.col("_c_" + o)).alias(o) for o in maxes])


def lag_of(df, keys, order, column, out):
    """Previous value of ``column``, which must be the leading (non-decreasing) order column."""
    return running(df, keys, order, maxes={out: column}, before=True)


def row_numbers(df, keys, order, out="rn"):
    return running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, sums={out: "_one"}).drop("_one")


def lookup_prefix(points, queries, keys, at, sums=None, maxes=None):
    """For every query row, sums / maxima over the points of its group with ``points.at <= queries.at``.

    Points and queries merge into one ordered sequence, so no pairs are formed. Returns the query rows.
    """
    sums, maxes = sums or {}, maxes or {}
    value_cols = list(dict.fromkeys([*sums.values(), *maxes.values()]))
    tagged_points = points.select(*keys, at, *value_cols).withColumn("_query", F.lit(0))
    tagged_queries = queries.withColumn("_query", F.lit(1))
    merged = tagged_points.unionByName(tagged_queries, allowMissingColumns=True)
    out = running(merged, keys, [at, "_query"], sums=sums, maxes=maxes).where("_query = 1")
    return out.select(*queries.columns, *sums, *maxes)


def quantiles(df, keys, value, probability, out="quantile"):
    """Exact linearly interpolated quantile per group, by rank and without holding a group in one task.

    Equal values collapse to a count first, so heavy ties cost nothing. ``probability`` may be a list; then ``out``
    becomes an array column in the same order, still from a single pass.
    """
    many = isinstance(probability, (list, tuple))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, keys, [value], sums={"_hi": "_n"})
    if keys:
        ranked = ranked.join(counts.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
    else:
        ranked = ranked.withColumn("_total", F.lit(counts.agg(F.sum("_n")).first()[0]))

    def at(index):  # zero-based rank -> the value whose run of ties covers it
        return F.max(F.when((F.col("_hi") - F.col("_n") <= index) & (index < F.col("_hi")), F.col(value))).cast("double")

    def interpolated(p):
        position = (F.col("_total") - 1) * F.lit(float(p))
        low, high = at(F.floor(position)), at(F.ceil(position))
        return low + (high - low) * F.max(position - F.floor(position))

    found = F.array(*[interpolated(p) for p in probability]) if many else interpolated(probability)
    return ranked.groupBy(*keys).agg(found.alias(out)) if keys else ranked.agg(found.alias(out))
