"""Exact histogram of encoded lengths; suffix sums answer every context limit.

Documents become (length, count) pairs inside the tasks that read them, so only distinct lengths are shuffled. With
docs and tokens summed over all lengths from a length upwards, any limit is answered exactly: with L the limit,
``sum(min(length, L)) = tokens shorter than L + L * docs of L or more``.

Defined cases: a null text is an empty one and has length 0; repeated rows count each time; an empty table gives an
empty histogram, of which every total is 0 and every quantile null. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from hosttrace.llm.tokens import encoder, parts, tokenizer_path

BLOCK = 1024


def length_counts(docs, text="text", path=None):
    """(n_tokens, n_docs) for each distinct encoded length, end id not counted."""
    path = path or tokenizer_path()

    def count(batches):
        for batch in batches:
            lengths = [encoder(path).encode(part)[1] - 1 for _, part in parts(batch.column(0))]
            if lengths:
                n, k = np.unique(np.concatenate(lengths), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(k, pa.int64())],
                                                 ["n_tokens", "n_docs"])

    return (docs.select(F.col(text)).mapInArrow(count, "n_tokens long, n_docs long")
            .groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def histogram(counts):
    """Suffix sums and truncated totals at each distinct length.

    Lengths are summed in blocks of 1,024 neighbouring lengths first; only block totals meet in one task.
    """
    rows = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{side}")
                                      for c in ("docs", "tokens") for side, w in (("after", after), ("before", before))])
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    below = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = (rows.join(blocks, "block")
           .withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("docs_after"))
           .withColumn("tokens_at_least", F.sum(tokens).over(inside) + F.col("tokens_after"))
           .withColumn("docs_below", F.coalesce(F.sum("n_docs").over(below), F.lit(0)) + F.col("docs_before"))
           .withColumn("tokens_below", F.coalesce(F.sum(tokens).over(below), F.lit(0)) + F.col("tokens_before")))
    return out.select("n_tokens", "n_docs", tokens.alias("tokens"), "docs_below", "tokens_below", "docs_at_least",
                      "tokens_at_least",
                      (F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"))


def at_limits(suffix, limits):
    """Documents and tokens of each limit or more, the truncated total and the tokens lost, for a list of limits.

    The least distinct length at or above a limit holds the answer, as no document lies between.
    """
    next_up = [F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("n_tokens") >= n, F.col("n_tokens")))
               .alias(f"l{k}") for k, n in enumerate(limits)]
    every = F.max(F.col("tokens_below") + F.col("tokens_at_least")).alias("every")
    one = suffix.agg(every, *next_up)
    rows = F.array(*[F.struct(F.lit(n).cast("long").alias("context"), F.coalesce(f"l{k}.docs_at_least", F.lit(0)).alias("docs"),
                              F.coalesce(f"l{k}.tokens_at_least", F.lit(0)).alias("over")) for k, n in enumerate(limits)])
    return (one.select(F.coalesce("every", F.lit(0)).alias("every"), F.explode(rows).alias("r"))
            .select("r.context", F.col("r.docs").alias("docs_at_least"), F.col("r.over").alias("tokens_at_least"),
                    (F.col("every") - F.col("r.over") + F.col("r.context") * F.col("r.docs")).alias("truncated_total"),
                    (F.col("r.over") - F.col("r.context") * F.col("r.docs")).alias("tokens_lost")))


def quantiles(suffix, shares):
    """The least length with at least that share of documents at or below it, for a list of shares."""
    upto, every = F.col("docs_below") + F.col("n_docs"), F.col("docs_below") + F.col("docs_at_least")
    return suffix.agg(*[F.min(F.when(upto >= F.lit(q) * every, F.col("n_tokens"))).alias(f"q{q:g}") for q in shares])
