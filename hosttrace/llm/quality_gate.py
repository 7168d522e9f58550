"""Quality rules whose cutoffs carry a guarantee on false rejection.

Each rule is a statistic of the text that is larger for worse texts. For each stratum (language) the labelled documents
are dealt into two halves by a hash of their id. The first half lays a path of ever stricter cutoffs for all rules
together: from "nothing is rejected" over steps towards the largest value of a good document to upper quantiles of the
good ones. The second half, the holdout, selects a point of the path: one is allowed if the exact (Clopper-Pearson)
upper bound on the share of good documents it rejects is at most ``risk``. Points are tried from the mildest on until
the first failure (fixed-sequence testing), so a stratum needs no correction of its own; delta is divided among the
strata (Bonferroni), so all bounds hold together with probability 1 - ``delta``. Among the allowed points the mildest
that rejects nearly as many bad documents as the strictest one is taken: what is not needed is not rejected. A stratum
with too few labels gets no cutoff.

Values are counted on a fixed grid of ``GRID`` steps in Spark; the driver sees counts, bounded by strata x rules x grid
(strata are language codes), and no document.

Defined cases: a null text is empty and fails the base rules; a null stratum is a stratum of its own (""); a null label
or doc_id takes no part in the fit; a doc_id with several labels counts once for each; an empty table gives no rows;
other columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hosttrace.llm.common import materialize, per_batch, small_batches, texts, worker_tool

RULES = ("symbols", "exclaimed", "capitals", "separators", "repeated", "dup_lines", "top_word", "long_word", "marks")
GRID = 200
RISK = 0.05
DELTA = 0.05
TOWARDS = (1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.0)
QUANTILES = (0.0005, 0.001, 0.002, 0.005)
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_SMALL, _LARGE = bytes(range(97, 123)), bytes(range(65, 91))
_MARKS = bytes(i for i in range(33, 127) if not chr(i).isalpha())


# ---------------------------------------------------------------- statistics of a text

def _repeat_words(words):
    """How many words lie in a window of five that occurs twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    number = {}
    w = [number.setdefault(x, len(number)) for x in words]
    k = len(number) + 1
    if k ** 5 < 1 << 62:
        a = np.array(w, np.int64)
        g = a[:n].copy()
        for j in range(1, 5):
            g = g * k + a[j:n + j]
        _, back, counts = np.unique(g, return_inverse=True, return_counts=True)
        twice = counts[back] > 1
    else:
        seen = {}
        for i in range(n):
            seen.setdefault((w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]), []).append(i)
        twice = np.zeros(n, bool)
        for at in seen.values():
            if len(at) > 1:
                twice[at] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += twice
    cover[5:] -= twice
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words); words are bytes."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # of bytes: at the six ASCII blanks alone
    seen, dup = set(), 0
    if "\n" in text:
        for line in raw.split(b"\n"):
            if line and not line.isspace():
                dup += line in seen
                seen.add(line)
    return (len(words), len(text) - sum(map(text.count, _BLANKS)), len(raw) - len(raw.translate(None, _SYMBOLS)), dup,
            _repeat_words(words), words)


def rule_values(text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words):
    """The statistics of ``RULES``, each between 0 and 1 (rates above 1 count as 1).

    Letters are A-Z, a-z and whatever is not ASCII; capitals are counted among A-Z and a-z.
    """
    n, chars = max(1, n_words), max(1, word_chars)
    raw = text.encode("utf-8", "replace")
    small, large = len(raw) - len(raw.translate(None, _SMALL)), len(raw) - len(raw.translate(None, _LARGE))
    marks = len(raw) - len(raw.translate(None, _MARKS))
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    top = max(counts.values(), default=0)
    values = (n_symbols / n, text.count("!") / n, large / max(1, small + large), text.count("|") / n, n_repeat_words / n,
              n_dup_lines / (text.count("\n") + 1), top / n if n >= 50 else 0.0, max(map(len, words), default=0) / 1000,
              marks / chars)
    return [min(1.0, max(0.0, v)) for v in values]


def statistics(docs, doc_id="doc_id", text="text", stratum="lang"):
    """Base counts and rule values of each row, in one pass over the whole texts."""
    kind = docs.schema[doc_id].dataType.simpleString()
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def one(batch):
        ints, rules = [], []
        for t in texts(batch.column(2)):
            *counts, words = base_counts(t)
            ints.append(counts)
            rules.append(rule_values(t, *counts, words))
        cols = [batch.column(0), pa.array([s or "" for s in batch.column(1).to_pylist()])]
        cols += [pa.array(c, pa.int64()) for c in zip(*ints)] + [pa.array(c, pa.float64()) for c in zip(*rules)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "stratum", *longs, *RULES])

    schema = f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in longs) + ", " + ", ".join(f"{c} double" for c in RULES)
    return docs.select(F.col(doc_id), F.col(stratum).cast("string"), F.col(text)).mapInArrow(per_batch(one), schema)


# ---------------------------------------------------------------- exact binomial bounds

def _log_tail(k, n, p):
    """log P(X <= k) for X ~ Binomial(n, p)."""
    if p <= 0:
        return 0.0
    if p >= 1:
        return 0.0 if k >= n else -math.inf
    i = np.arange(k + 1)
    lg = np.array([math.lgamma(x + 1) for x in range(n + 1)]) if n < 2000 else None
    if lg is not None:
        terms = lg[n] - lg[i] - lg[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)
    else:
        terms = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i.tolist()]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(top + math.log(np.exp(terms - top).sum()))


def upper_bound(k, n, delta):
    """Clopper-Pearson: the largest p with P(X <= k) >= delta."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        if _log_tail(k, n, mid) >= math.log(delta):
            low = mid
        else:
            high = mid
    return high


def within(k, n, risk, delta):
    """Whether the upper bound is at most ``risk``, without finding it."""
    return n > 0 and k < n * risk and _log_tail(k, n, risk) <= math.log(delta)


def lay_paths(counts):
    """{stratum: {rule: cutoff steps, from mild to strict}} from (stratum, rule, step, n) rows of good documents."""
    hist = {}
    for s, r, step, n in counts:
        hist.setdefault(s, {}).setdefault(r, np.zeros(GRID + 1, np.int64))[step] += n
    out = {}
    for s, rules in hist.items():
        out[s] = {}
        for r in RULES:
            h = rules[r]
            most = int(np.flatnonzero(h)[-1])
            upto = np.cumsum(h) / h.sum()
            path = [most + round(share * (GRID - most)) for share in TOWARDS]
            out[s][r] = path + [int(np.searchsorted(upto, 1 - q - 1e-12)) for q in QUANTILES]
    return out


def levels(path):
    """For each grid step the first point of a path that rejects it; the path's length if none does."""
    return [next((k for k, cut in enumerate(path) if step > cut), len(path)) for step in range(GRID + 1)]


def select(paths, counts, risk=RISK, delta=DELTA):
    """{stratum: point of its path} from (stratum, quality, level, n) rows of the holdout."""
    size = len(TOWARDS) + len(QUANTILES)
    rejected = {s: np.zeros((2, size + 1), np.int64) for s in paths}
    for s, quality, level, n in counts:
        if s in rejected:
            rejected[s][int(quality), level] += n
    out = {}
    for s, h in rejected.items():
        bad, good = np.cumsum(h[0]), np.cumsum(h[1])
        allowed = []
        for k in range(size):
            if not within(int(good[k]), int(h[1].sum()), risk, delta / len(paths)):
                break
            allowed.append(k)
        if allowed and bad[allowed[-1]]:
            out[s] = next(k for k in allowed if bad[k] >= 0.995 * bad[allowed[-1]])
    return out


def step_of(value):
    """The grid step of a rule value."""
    return F.ceil(value * GRID).cast("int")


def fit(stats, labels, risk=RISK, delta=DELTA, doc_id="doc_id", quality="quality"):
    """{(stratum, rule): cutoff step} from all labelled rows of ``stats``; values at a higher step are rejected.

    Documents that fail the base rules are rejected anyway and take no part.
    """
    spark = stats.sparkSession
    known = (labels.select(F.col(doc_id).alias("id"), F.col(quality).cast("int").alias("quality"))
             .where("id IS NOT NULL AND quality IN (0, 1)"))
    rows = materialize(stats.where(~base_failed()).join(known, F.col("doc_id") == F.col("id"))
                       .select("stratum", "quality", F.pmod(F.xxhash64("id"), F.lit(2)).alias("half"), *[step_of(F.col(r)).alias(r) for r in RULES]),
                       "quality-labels")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES]))
    good = (rows.where("half = 0 AND quality = 1").select("stratum", each.alias("x")).groupBy("stratum", "x.rule", "x.step")
            .agg(F.count(F.lit(1)).alias("n")))
    paths = lay_paths([(r["stratum"], r["rule"], r["step"], r["n"]) for r in good.collect()])
    if not paths:
        return {}
    table = spark.createDataFrame([(s, *[levels(p[r]) for r in RULES]) for s, p in paths.items()],
                                  "s string, " + ", ".join(f"level_{r} array<int>" for r in RULES))
    first = F.least(*[F.element_at(f"level_{r}", F.col(r) + 1) for r in RULES])
    held = (rows.where("half = 1").join(F.broadcast(table), F.col("stratum") == F.col("s"))  # a row for each language
            .groupBy("stratum", "quality", first.alias("level")).agg(F.count(F.lit(1)).alias("n")))
    points = select(paths, [(r["stratum"], r["quality"], r["level"], r["n"]) for r in held.collect()], risk, delta)
    return {(s, r): paths[s][r][k] for s, k in points.items() for r in RULES}


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(stats, cutoffs):
    """``stats`` with base_failed, rejected_by (rules) and kept."""
    over = []
    for r in RULES:
        limit = F.lit(None).cast("int")
        for (s, rule), step in cutoffs.items():
            if rule == r:
                limit = F.when(F.col("stratum") == s, F.lit(step)).otherwise(limit)
        over.append(F.when(step_of(F.col(r)) > limit, F.lit(r)))
    return (stats.withColumn("base_failed", base_failed())
            .withColumn("rejected_by", F.array_compact(F.array(*over)))
            .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)))


def assess(docs, labels, doc_id="doc_id", text="text", stratum="lang", risk=RISK, delta=DELTA):
    """Every row's counts, rule values and verdict, with cutoffs fitted on ``labels``."""
    stats = materialize(statistics(docs, doc_id, text, stratum), "quality-statistics")
    return judge(stats, fit(stats, labels, risk, delta))


def verdict(text, stratum, cutoffs):
    """Whether one text is kept."""
    *counts, words = base_counts(text)
    n, repeat = counts[0], counts[4]
    if n < 10 or 100 * repeat > 20 * n:
        return False
    values = rule_values(text, *counts, words)
    return not any(math.ceil(v * GRID) > cutoffs.get((stratum, r), GRID) for r, v in zip(RULES, values))


def kept_documents(docs, labels, doc_id="doc_id", text="text", stratum="lang", risk=RISK, delta=DELTA):
    """``docs`` without the rejected rows.

    The verdict depends on text and stratum alone, so it is found again in the task that reads a row: only statistics
    are shuffled, never texts.
    """
    small_batches(docs.sparkSession)  # whole rows go through Python
    cutoffs = fit(statistics(docs, doc_id, text, stratum), labels, risk, delta)
    i_text, i_stratum = docs.columns.index(text), docs.columns.index(stratum)

    def run(batches):
        worker_tool(None)
        for batch in batches:
            strata = batch.column(i_stratum).cast(pa.string()).to_pylist()
            keep = [verdict(t, s or "", cutoffs) for t, s in zip(texts(batch.column(i_text)), strata)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
