"""Toxicity classifier with a counterfactual penalty.

A logistic model over words and word beginnings. For each labelled training text that names a group, a second text is
made by swapping identity terms for others of their kind; the fit adds ``penalty`` times the squared difference of both
scores' logits, so a neutral mention of a group cannot carry weight of its own.

The vocabulary comes from document frequencies of each feature among toxic and other training texts, counted in Spark
over all of them; the ``FEATURES`` with the largest chi-squared go into the model. Weights are fitted on the driver on a
sample of at most ``TRAIN_ROWS`` labelled texts, the ones with the smallest hash of their id (all, if there are fewer); a
row is at most ``FEATURES`` numbers there, so the fit's memory is bounded. Scoring runs in the tasks that read the
documents, on whole texts. Labels go to the texts: they are counted, and broadcast up to ``BROADCAST_LABELS`` rows; more
are joined by a shuffle, and the labelled texts are then written once.

Inputs of a score are words alone: never labels, language, source or id.

Defined cases: a null or empty text is scored like any other (it has the intercept alone); labels that are null or not 0
or 1, and null ids, take no part in the fit; a doc_id with several labels counts as several rows; without labels of both
kinds every score is 0.5 to the data's prior; repeated rows give repeated results; other columns are not read.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hosttrace.llm.common import materialize, texts

FEATURES = 4096
TRAIN_ROWS = 20_000
BROADCAST_LABELS = 2_000_000  # rows of an id and a label, some 25 bytes each
LEAST_DOCS = 5
PENALTY = 1.0
RIDGE = 1e-3
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
# Identity terms by kind; a term is swapped for the next of its list.
IDENTITY = {
    "religion": "christian muslim jewish hindu buddhist atheist sikh catholic".split(),
    "people_en": "women men girls boys".split(), "person_en": "woman man girl boy".split(),
    "origin": "african asian european american mexican indian chinese arab turkish polish german french spanish".split(),
    "orientation": "gay lesbian bisexual straight transgender queer".split(),
    "colour": "black white brown".split(),
    "fr": "femmes hommes filles garçons".split(), "fr_religion": "chrétien musulman juif bouddhiste athée".split(),
    "de": "frauen männer mädchen jungen".split(), "de_religion": "christ muslim jude buddhist atheist".split(),
    "es": "mujeres hombres chicas chicos".split(), "es_religion": "cristiano musulmán judío budista ateo".split(),
}
SWAP = {w: terms[(k + 1) % len(terms)] for terms in IDENTITY.values() for k, w in enumerate(terms)}


def features_of(words):
    """Features of a text's words: the words and their beginnings, with how often each occurs."""
    out = Counter(words)
    for w, n in list(out.items()):
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "-"] += n
    return out


def words_of(text):
    return _WORD.findall(text.lower())


def swapped(words):
    """The counterfactual of a text's words; None if it names no group."""
    out = [SWAP.get(w, w) for w in words]
    return out if out != words else None


def held_out(doc_id):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


# ---------------------------------------------------------------- fit

def feature_counts(train):
    """(feature, toxic, n): in how many training texts of each label a feature occurs, added up by task first."""
    def run(batches):
        found = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                found[y].update(features_of(words_of(t)).keys())
            if len(found[0]) + len(found[1]) > 500_000:
                yield _counts(found)
                found = (Counter(), Counter())
        if found[0] or found[1]:
            yield _counts(found)

    return (train.select("text", "toxic").mapInArrow(run, "feature string, other long, toxic long").groupBy("feature")
            .agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")))


def _counts(found):
    names = list(found[0].keys() | found[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(names), *[pa.array([f[n] for n in names], pa.int64()) for f in found]], ["feature", "other", "toxic"])


def vocabulary(counts, n_other, n_toxic, size=FEATURES):
    """The ``size`` features with the largest chi-squared statistic, those of at least ``LEAST_DOCS`` texts."""
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    c, d = F.lit(float(n_toxic)) - a, F.lit(float(n_other)) - b
    n = float(n_other + n_toxic)
    chi = F.lit(n) * F.pow(a * d - b * c, F.lit(2.0)) / F.greatest(F.lit(1.0), (a + b) * (c + d) * F.lit(float(n_other)) * F.lit(float(n_toxic)))
    rows = counts.where(F.col("toxic") + F.col("other") >= LEAST_DOCS).withColumn("chi", chi).orderBy(F.desc("chi"), "feature").limit(size)
    return [r["feature"] for r in rows.select("feature").collect()]


def vector(words, index, memory=None):
    """(columns, values) of a text: 1 + log of how often each feature of the model occurs.

    ``memory`` keeps the columns of words seen before; it is emptied when it is full.
    """
    memory = {} if memory is None else memory
    if len(memory) > 300_000:
        memory.clear()
    found = {}
    for w, n in Counter(words).items():
        cols = memory.get(w)
        if cols is None:
            names = [w, *[w[:k] + "-" for k in PREFIXES if len(w) > k]]
            cols = memory[w] = [index[f] for f in names if f in index]
        for c in cols:
            found[c] = found.get(c, 0) + n
    return np.fromiter(found, np.int64, len(found)), 1 + np.log(np.fromiter(found.values(), np.float64, len(found)))


def _packed(pair):
    return pair[0].astype("<i4").tobytes(), pair[1].astype("<f4").tobytes()


def _unpacked(c, v):
    return np.frombuffer(c, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)


class Rows:
    """Sparse rows with the two products a gradient needs."""

    def __init__(self, vectors, width):
        self.row = np.repeat(np.arange(len(vectors)), [len(c) for c, _ in vectors])
        self.col = np.concatenate([c for c, _ in vectors]) if vectors else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in vectors]) if vectors else np.zeros(0)
        self.n, self.width = len(vectors), width

    def dot(self, w):
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r):
        return np.bincount(self.col, self.val * r[self.row], self.width)


def fit_weights(x, y, differ, penalty=PENALTY, ridge=RIDGE, rounds=300):
    """Weights and intercept by accelerated gradient steps.

    ``differ`` has the difference of each counterfactual pair's vectors; the intercept drops out of it.
    """
    n, width = x.n, x.width
    w, b = np.zeros(width), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, vb, t = w.copy(), b, 1.0
    scale = np.sqrt(np.bincount(x.col, x.val ** 2, width) / n + 1e-4)  # equal footing for rare features
    lipschitz = 0.25 * (np.bincount(x.row, (x.val / scale[x.col]) ** 2, n).mean() + 1) + ridge
    if differ.n:
        lipschitz += 2 * penalty * np.bincount(differ.row, (differ.val / scale[differ.col]) ** 2, differ.n).max()
    step = 4.0 / lipschitz
    last = np.inf
    for _ in range(rounds):
        u = v / scale
        z = x.dot(u) + vb
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        loss = float(-(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).mean()) + ridge / 2 * float(v @ v)
        g = x.back((p - y) / n) / scale + ridge * v
        if differ.n:
            d = differ.dot(u)
            loss += penalty * float((d ** 2).mean())
            g += 2 * penalty * differ.back(d / differ.n) / scale
        if loss > last:  # the step was too long: start again from here with a shorter one
            step, t = step * 0.7, 1.0
            v, vb = w.copy(), b
            last = np.inf
            continue
        last = loss
        new, new_b = v - step * g, vb - step * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w / scale, b


def fit(docs, labels, doc_id="doc_id", text="text", toxic="toxic", penalty=PENALTY, rows=TRAIN_ROWS, size=FEATURES):
    """{"index", "weights", "intercept"} from all labelled rows that are not held out."""
    known = (labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic"))
             .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("id")))
    few = known.count() <= BROADCAST_LABELS
    train = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(known) if few else known, F.col("doc_id") == F.col("id")).select("id", "text", "toxic")
    if not few:
        train = materialize(train, "toxicity-training")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_other, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_other or not n_toxic:
        return {"index": {}, "weights": np.zeros(0), "intercept": 0.0}
    names = vocabulary(feature_counts(train), n_other, n_toxic, size)
    index = {f: k for k, f in enumerate(names)}

    def run(batches):
        memory = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for t, y in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                words = words_of(t)
                other = swapped(words)
                rows.append((y, *_packed(vector(words, index, memory)), *(_packed(vector(other, index, memory)) if other else (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))], ["y", "c", "v", "c2", "v2"])

    # The sample is a threshold on a hash of the id that aims four deviations below the bound, so the limit, which would
    # drop rows by partition order, guards against one draw in thirty thousand.
    share = 1.0 if n_other + n_toxic <= rows else max(0.0, rows - 4 * rows ** 0.5) / (n_other + n_toxic)
    chosen = train.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else train
    sample = chosen.select("text", "toxic").mapInArrow(run, "y long, c binary, v binary, c2 binary, v2 binary").limit(rows).collect()
    x = Rows([_unpacked(r["c"], r["v"]) for r in sample], len(names))
    y = np.array([r["y"] for r in sample], np.float64)
    differ = []
    for r in sample:
        if r["c2"] is not None:
            (c, v), (c2, v2) = _unpacked(r["c"], r["v"]), _unpacked(r["c2"], r["v2"])
            differ.append((np.concatenate([c, c2]), np.concatenate([v, -v2])))
    weights, intercept = fit_weights(x, y, Rows(differ, len(names)), penalty)
    return {"index": index, "weights": weights, "intercept": intercept}


def score_text(text, model, memory=None):
    c, v = vector(words_of(text), model["index"], memory)
    return 1 / (1 + np.exp(-np.clip(float((model["weights"][c] * v).sum()) + model["intercept"], -35, 35)))


def score(docs, model, doc_id="doc_id", text="text", threshold=0.3):
    """(doc_id, held_out, score, predicted) of each row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        memory = {}
        for batch in batches:
            s = [float(score_text(t, model, memory)) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, score double")
    return rows.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
                       F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
