"""Deterministic splits. A fold is a column; no index arrays leave the cluster."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hosttrace.operators.ordered import quantiles, row_numbers


def hash_bucket(group, seed, buckets):
    """Stable bucket of a group: eight hex digits of its salted MD5, modulo."""
    digest = F.md5(F.concat(group.cast("string"), F.lit("|"), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def group_shuffle(df, group, test_share=0.3, seed=0):
    """Whole groups to train or test."""
    return df.withColumn("is_test", hash_bucket(F.col(group), seed, 10_000) < int(test_share * 10_000))


def stratified_rows(df, row_id, label="label", test_share=0.3, seed=0):
    """The given share of each class goes to test: rows whose salted hash is at most the class's hash quantile."""
    hashed = df.withColumn("_h", hash_bucket(F.col(row_id), seed, 2**31 - 1).cast("long"))
    cut = quantiles(hashed, [label], "_h", test_share, "_cut")
    return hashed.join(cut, label, "left").withColumn("is_test", F.col("_h") <= F.col("_cut")).drop("_h", "_cut")


def benign_train_split(df, row_id, label="label", train_share=0.9, seed=0):
    """Train on a share of the benign rows only; test on the other benign rows and on every attack row."""
    train = (F.col(label) == 0) & (hash_bucket(F.col(row_id), seed, 10_000) < int(train_share * 10_000))
    return df.withColumn("is_test", ~train)


def stratified_group_folds(df, group, label="label", k=5, seed=0, out="fold"):
    """Group folds with balanced class counts and no group on both sides.

    Groups of equal make-up are dealt round-robin in hash order: first all groups of a (positives, size) class, then
    the next. Dealing happens per class of groups, pre-aggregated, never over single rows; the rank within a class
    comes from chunked running counts, so a class of any size is dealt alike.
    """
    sizes = df.groupBy(group).agg(F.sum(F.col(label).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    dealt = sizes.withColumns({
        "_class": F.concat_ws("/", *[F.length(F.bin(c)).cast("string") for c in (F.col("_pos") + 1, F.col("_n"))]),
        "_h": F.md5(F.concat(F.col(group).cast("string"), F.lit("|"), F.lit(str(seed))))})
    ordered = dealt.where(F.col(group).isNotNull()).withColumns({"_less": -F.col("_pos"), "_fewer": -F.col("_n")})
    ranked = row_numbers(ordered, ["_class"], ["_less", "_fewer", "_h", group])
    folds = ranked.select(group, ((F.col("rn") - 1 + hash_bucket(F.col("_class"), seed, k)) % k).cast("int").alias(out))
    return df.join(folds, group)


def repeated_group_folds(df, group, label="label", k=5, repeats=5):
    """The same rows once per repeat, each with its own fold column: fold_0 ... fold_{repeats-1}."""
    for r in range(repeats):
        df = stratified_group_folds(df, group, label, k, seed=r, out=f"fold_{r}")
    return df


def overlapping_groups(df, group, fold="fold"):
    """Groups that sit in more than one fold: must be empty."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def run_index_folds(df, k, scenario=("platform", "session"), run="run_id"):
    """Fold = position of the run among the runs of its scenario, modulo k: one recording of every scenario each."""
    runs = row_numbers(df.select(*scenario, run).distinct(), list(scenario), [run])
    return df.join(runs.select(*scenario, run, ((F.col("rn") - 1) % k).cast("int").alias("fold")), [*scenario, run])


def held_out_values(df, column, where=None):
    """Distinct values to hold out one at a time: runs, scenarios, machines or repetitions, never rows."""
    rows = df.where(where) if where is not None else df
    return sorted(r[0] for r in rows.select(column).distinct().collect() if r[0] is not None)


def held_out_sizes(df, column, where=None):
    """(held_out, n_test, n_train) for each value to hold out: one grouped count, and what is left of the total."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("held_out")).agg(
        F.count_if(hit).alias("n_test"), F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))  # one row
    return counts.where("n_test > 0").join(F.broadcast(total)).select("held_out", "n_test", (F.col("_total") - F.col("_n")).alias("n_train"))


def leave_one_out(df, column, where=None):
    """(value, train, test) for every held-out value."""
    for value in held_out_values(df, column, where):
        hit = F.col(column) == value
        yield value, df.where(~hit), df.where(hit)


def repetition_numbers(runs, keys=("platform", "session"), start="start"):
    """Number the runs of a scenario in order of their start. One row per run goes in."""
    return row_numbers(runs, list(keys), [start, "run_id"], "rep")


def stratified_sample(df, cell, per_cell, row_id, seed=0):
    """The same ``per_cell`` rows of every cell on every run, in salted-hash order.

    Spark limits each task's contribution to a cell before the shuffle, so large cells stay cheap.
    """
    w = Window.partitionBy(*cell).orderBy(
        F.md5(F.concat(F.col(row_id).cast("string"), F.lit("|"), F.lit(str(seed)))), row_id)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_cell).drop("_r")


def top_per_group(df, group, by, k):
    """Top k rows per group; ``by`` is a list of ordering Columns. Limited per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
