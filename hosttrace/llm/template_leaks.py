"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question whose values were changed keeps its template. Every
window of ``WINDOW`` template words of the benchmark is hashed; documents' windows are joined with them by hash. For
each (document, item) pair the matched windows give the share of the item's template that the document holds, and
what stands in the item's slots. Numbers and units may coincide or part by chance, so they decide only where coverage is low. Of the
slots with names at least half must be kept: the name is the item's own, or it stands for more than half of the slots of
that item name and the other way round.

Windows with fewer than ``LITERALS`` words of their own say nothing as templates ("1 2 3 4 ..."): they are hashed with their values, so
copies of them count and tables of numbers do not meet.

A capitalised word that opens a sentence may be a name or not: windows with such words are hashed twice, with the words
written small and with <name> in their place, on both sides. A match of either is a match.

Matches of a pair lie on alignments (document place less item place); a word put in or left out moves the rest of a copy
to the next one. So alignments that differ by less than ``BAND``, or a quarter of a longer item, are judged together.
A pair is a leak if its windows cover at least ``SHARE`` of the item's words, or an unbroken run of ``RUN`` words, and its
name slots are consistent; below ``CERTAIN`` and without such a run, half of its number and unit slots must be kept or stand
one for one as well; it is ``copied`` if the slots have the item's own values, else ``reparameterised``.

Windows of documents are made in the tasks that read them, and only those found in the benchmark's set of hashes go on,
so what is shuffled is bounded by true template matches. The set goes to the tasks in blocks of at most
``BLOCK_HASHES`` (8 bytes each), one pass over the documents for each block: its size is checked and any benchmark is
worked off whole.

Defined cases: null texts are empty; an item of fewer than ``WINDOW`` words has one window, its whole template, which is
matched as such; items without a word match nothing; null ids are kept as null; repeated rows of a document or an item
count once for each id; an empty table on either side gives no leaks; other columns are not read.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from hosttrace.llm.common import free_name, materialize, worker_tool
from hosttrace.llm.tokens import WordTable, parts, word_bounds

WINDOW = 8
SHARE = 0.5
RUN = 25
BAND = 16
LITERALS = 2
CERTAIN = 0.8
BLOCK_HASHES = 2_000_000
# Unit symbols and words that are replaced after a number.
UNITS = frozenset("""mm cm m km mi ft in inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz ton tons gram
    grams kilogram kilograms pound pounds ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months
    year years mph kmh percent dollar dollars euro euros cent cents usd eur gbp degree degrees celsius fahrenheit w kw v kv a hz khz mhz ghz j kj n pa kpa mol""".split())
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
    twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split())
_TOKEN = re.compile(r"[$€£]?\d+(?:[.,:/]\d+)*%?|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?]")


def canonical(text):
    """(template words, values) of one text: values are the words replaced, None where the word stands for itself.

    A number is <num>; a unit right after a number is <unit>; a capitalised word within a sentence is <name>. The first
    word of a sentence is written small. This is the rule that ``TemplateWords`` follows for batches.
    """
    words, values = [], []
    first, after_number = True, False
    for low, kind in tokens_of(text.replace("\n", " . ")):
        if kind == "end":
            first = True
            continue
        place = ("<num>" if kind == "number" else "<unit>" if kind == "unit" and after_number else
                 "<name>" if kind == "name" and not first else None)
        words.append(place or low)
        values.append(low if place else None)
        first, after_number = False, kind == "number"
    return words, values


def tokens_of(chunk):
    """(lower-case word, kind) of the tokens of a text without blanks; kinds as in ``_KINDS``, "" is a sentence end."""
    out = []
    for m in _TOKEN.finditer(chunk):
        w, c = m[0], m[0][0]
        low = w.lower()
        if c in ".!?":
            out.append(("", "end"))
        elif not c.isalpha() or low in NUMBER_WORDS:
            out.append((low, "number"))
        elif low in UNITS:
            out.append((low, "unit"))
        else:
            out.append((low, "name" if c.isupper() and len(w) > 1 and not w.isupper() else "word"))
    return out


_KINDS = ("word", "name", "unit", "number", "end")
NAME = np.uint64(xxhash.xxh3_64_intdigest("<name>"))
_LINE_END = b"\x02"  # stands for a line end, which is a blank otherwise


class TemplateWords(WordTable):
    """Canonical words of batches of texts. Each distinct (word, kind) has a code, with its hash and kind in arrays."""

    kind = np.int32
    most = 400_000

    def forget(self):
        super().forget()
        self.codes, self.names = {}, []
        self.hash, self.kinds = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int8)

    def word(self, chunk):
        tokens = [("", "end")] if chunk == _LINE_END else tokens_of(chunk.decode("utf-8", "replace"))
        out = []
        for token in tokens:
            code = self.codes.get(token)
            if code is None:
                code = self.codes[token] = len(self.names)
                if code == len(self.kinds):
                    self.hash, self.kinds = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hash, self.kinds))
                self.names.append(token[0])
                self.hash[code], self.kinds[code] = xxhash.xxh3_64_intdigest(token[0]), _KINDS.index(token[1])
            out.append(code)
        return out

    def templates(self, texts):
        """(codes, hashes, placeholders, ends): all texts' template words in a row; ``ends`` is where each text's end."""
        return self.templates_and_openings(texts)[:4]

    def templates_and_openings(self, texts):
        """``templates`` and which words are capitalised at the start of a sentence."""
        texts = [t.replace(b"\n", b" \x02 ") for t in texts]
        data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        starts, stops = word_bounds(raw)
        codes, upto = self.numbers(self.places(data, raw, starts, stops))
        n_chunks = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        text_ends = np.concatenate([[0], upto])[n_chunks]
        kinds = self.kinds[codes]
        is_word = kinds != 4
        opening = np.zeros(len(codes) + 1, bool)
        opening[0] = True
        opening[text_ends] = True
        opening[1:] |= ~is_word
        first = opening[:-1][is_word]
        before = np.concatenate([[0], np.cumsum(is_word)])
        ends = before[text_ends]
        codes, kinds = codes[is_word], kinds[is_word]
        number = kinds == 3
        after_number = np.concatenate([[False], number[:-1]]) if len(number) else number
        after_number[ends[ends < len(number)]] = False
        unit = (kinds == 2) & after_number
        name = (kinds == 1) & ~first
        hashes = self.hash[codes]
        for mask, label in ((number, "<num>"), (unit, "<unit>"), (name, "<name>")):
            hashes[mask] = xxhash.xxh3_64_intdigest(label)
        return codes, hashes, number | unit | name, ends, (kinds == 1) & first


def template_words():
    """The table of this Python worker."""
    return worker_tool("template words", TemplateWords)


def window_hashes(hashes, ends, window=WINDOW):
    """(places, hashes) of all windows that lie within a text; a shorter text is one window. Hashes are signed."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(hashes)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    lengths = ends - starts
    out, places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= window:
        out = np.zeros(n - window + 1, np.uint64)
        for k in range(window):
            out = out * base + hashes[k:n - window + 1 + k]
        fits = np.zeros(n + 1, np.int64)
        long = lengths >= window
        np.add.at(fits, starts[long], 1)
        np.add.at(fits, ends[long] - window + 1, -1)
        places = np.flatnonzero(np.cumsum(fits[:n - window + 1]) > 0)
        out = out[places]
    short = np.flatnonzero((lengths > 0) & (lengths < window))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, t in enumerate(short.tolist()):
            h = int(lengths[t])
            for x in hashes[starts[t]:ends[t]].tolist():
                h = (h * int(base) + x) & (1 << 64) - 1
            extra[k] = h
        places, out = np.concatenate([places, starts[short]]), np.concatenate([out, extra])
        order = np.argsort(places, kind="stable")
        places, out = places[order], out[order]
    return places, out.view(np.int64)


class Wanted:
    """Membership in a set of hashes: a bit map first, then a search."""

    def __init__(self, hashes):
        self.sorted = np.sort(hashes)
        self.map = np.zeros(1 << 22, bool)
        self.map[self._slot(self.sorted)] = True

    @staticmethod
    def _slot(h):
        return (h.view(np.uint64) >> np.uint64(42)).astype(np.int64)

    def hits(self, h):
        """Indexes of ``h`` that are members."""
        maybe = np.flatnonzero(self.map[self._slot(h)])
        if not len(maybe):
            return maybe
        k = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[k] == h[maybe]]


def windows_of(rows, row_id, text, wanted=None, window=WINDOW):
    """(id, place, hash, slots, n_windows) of each row's windows, of those in ``wanted`` (hashes) if given."""
    kind = rows.schema[row_id].dataType.simpleString()

    def run(batches):
        tool = template_words()
        member = Wanted(wanted) if wanted is not None and len(wanted) else None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, part in parts(batch.column(1)):
                codes, hashes, slot, ends, opening = tool.templates_and_openings(part)
                places, h = window_hashes(hashes, ends, window)
                named = window_hashes(np.where(opening, NAME, hashes), ends, window)[1]
                starts = np.concatenate([[0], ends[:-1]])
                stops = np.minimum(places + window, ends[np.searchsorted(ends, places, side="right")])
                own = window_hashes(tool.hash[codes], ends, window)[1]
                for hashed, kept in ((h, slot), (named, slot | opening)):
                    literal = np.concatenate([[0], np.cumsum(~kept)])
                    few = literal[stops] - literal[places] < LITERALS
                    hashed[few] = own[few]
                other = np.flatnonzero(named != h)
                n_plain = len(h)
                places, h = np.concatenate([places, places[other]]), np.concatenate([h, named[other]])
                either = slot | opening
                if wanted is None:
                    found = np.arange(len(h))
                elif member is None:
                    continue
                else:
                    found = member.hits(h)
                if not len(found):
                    continue
                owner = np.searchsorted(ends, places[found], side="right")
                counts = np.maximum(1, ends - starts - window + 1)
                values = [[tool.names[codes[q]] if kept[q] else None for q in range(p, min(p + window, e))]
                          for p, e, kept in zip(places[found].tolist(), ends[owner].tolist(), (slot if k < n_plain else either for k in found.tolist()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[at + k] for k in owner.tolist()], batch.column(0).type), pa.array(places[found] - starts[owner]),
                     pa.array(h[found]), pa.array(values, pa.list_(pa.string())), pa.array(counts[owner])],
                    ["id", "place", "hash", "slots", "n_windows"])

    return rows.select(F.col(row_id), F.col(text)).mapInArrow(run, f"id {kind}, place long, hash long, slots array<string>, n_windows long")


def matches(docs, benchmark, doc_id="doc_id", item_id="item_id", text="text"):
    """(doc_id, item_id, doc_place, item_place, doc_slots, item_slots, item_windows) for each window in common."""
    items = materialize(windows_of(benchmark, item_id, text), "benchmark-windows")
    hashes = items.select("hash").distinct()
    blocks = -(-hashes.count() // BLOCK_HASHES)
    side = items.groupBy("hash", "id", "place", "slots", "n_windows").agg(F.lit(1).alias("one")).select(
        F.col("hash").alias("item_hash"), F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), F.col("n_windows").alias("item_windows"))
    found = None
    for b in range(max(1, blocks)):
        rows = hashes.where(F.pmod(F.xxhash64("hash"), F.lit(max(1, blocks))) == b).toArrow()
        wanted = rows.column(0).to_numpy().astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)
        part = windows_of(docs, doc_id, text, wanted)
        found = part if found is None else found.unionByName(part)
    return found.join(side, F.col("hash") == F.col("item_hash")).select(
        F.col("id").alias("doc_id"), "item_id", F.col("place").alias("doc_place"), "item_place",
        F.col("slots").alias("doc_slots"), "item_slots", "item_windows")


def _kept(x, slots):
    """Whether the slot x has the item's value, or pairs two values that mostly stand for each other."""
    times = lambda *fields: F.size(F.filter(slots, lambda z: F.forall(F.array(*[z[f] == x[f] for f in fields]), lambda same: same)))
    return (x["i"] == x["d"]) | ((times("i", "d") * 2 > times("i")) & (times("i", "d") * 2 > times("d")))


def judge(matched, share=SHARE, run=RUN):
    """One row for each (doc_id, item_id): matched windows, share of words covered, longest run, slot consistency and verdict.

    Aligned windows of a pair lie on diagonals (document place less item place). Bands are twice as wide as the reach and
    overlap by half, so any two diagonals within the reach are in one of them; each band is a possible copy of the item,
    and so is each diagonal alone, as a repetitive item also matches beside itself.
    Everything is a grouped aggregate with distinct-bounded state: at most the item's windows a diagonal.
    """
    # (place, item's value, document's value) of each slot
    slot = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.filter(
        F.transform(F.arrays_zip(w["item_slots"], w["doc_slots"]), lambda z, k: F.struct(
            (w["item_place"] + k).alias("p"), z["item_slots"].alias("i"), z["doc_slots"].alias("d"))),
        lambda z: z["i"].isNotNull()))))
    diagonal = (matched.withColumn("shift", F.col("doc_place") - F.col("item_place"))
                .groupBy("doc_id", "item_id", "shift")
                .agg(F.max("item_windows").alias("item_windows"), F.collect_set("item_place").alias("places"),
                     F.collect_set(F.struct("item_place", "item_slots", "doc_slots")).alias("windows"))
                .withColumn("slots", slot).drop("windows"))
    reach = F.greatest(F.lit(BAND), F.floor(F.col("item_windows") / 4))
    band = F.floor(F.col("shift") / reach)
    alone = lambda yes, at: F.struct(F.lit(yes).alias("alone"), at.alias("at"))
    rows = (diagonal.withColumn("band", F.explode(F.array(alone(False, band), alone(False, band + 1), alone(True, F.col("shift")))))
            .groupBy("doc_id", "item_id", "band")
            .agg(F.max("item_windows").alias("item_windows"),
                 F.max_by("shift", F.struct(F.size("places"), -F.abs("shift"), F.col("shift"))).alias("shift"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
                 F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots")))
    zero = F.lit(0).cast("long")

    def step(acc, p):
        now = F.when(p == acc["last"] + 1, acc["now"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(p.alias("last"), now.alias("now"), F.greatest(acc["best"], now).alias("best"),
                        (acc["words"] + F.least(F.lit(WINDOW).cast("long"), p - acc["last"])).alias("words"))

    start = F.struct(F.lit(-WINDOW).cast("long").alias("last"), zero.alias("now"), zero.alias("best"), zero.alias("words"))
    rows = rows.withColumn("walk", F.aggregate("places", start, step)).withColumn("longest", F.col("walk.best"))
    rows = (rows.withColumn("n_matched", F.size("places").cast("long"))
            .withColumn("n_slots", F.size(F.array_distinct(F.transform("slots", lambda z: F.struct(z["i"], z["d"])))))
            .withColumn("names", F.filter("slots", lambda z: z["i"].rlike(r"^\p{L}") & ~z["i"].isin(*NUMBER_WORDS, *UNITS)))
            .withColumn("numbers", F.array_except("slots", "names"))
            .withColumn("consistent", F.size(F.filter("names", lambda x: _kept(x, "names"))) * 2 >= F.size("names"))
            .withColumn("steady", F.size(F.filter("numbers", lambda x: _kept(x, "numbers"))) * 2 >= F.size("numbers"))
            .withColumn("same_values", F.forall("slots", lambda z: z["i"] == z["d"])))
    # An item of one window is matched whole or not at all.
    rows = rows.withColumn("coverage", F.when(F.col("item_windows") == 1, F.lit(1.0)).otherwise(F.col("walk.words") / (F.col("item_windows") + WINDOW - 1)))
    rows = rows.withColumn("leak", F.col("consistent") & (
        (F.col("coverage") >= CERTAIN) | (F.col("longest") + WINDOW - 1 >= run) | (F.col("coverage") >= share) & F.col("steady")))
    best = F.max_by(F.struct("shift", "n_matched", "coverage", "longest", "n_slots", "consistent", "same_values", "leak"),
                    F.struct("leak", "n_matched", "same_values", (-F.abs("shift")).alias("near"), "shift"))
    return (rows.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", F.col("b.shift").alias("shift"), F.col("b.n_matched").alias("n_matched"), F.round("b.coverage", 6).alias("coverage"),
        (F.col("b.longest") + WINDOW - 1).alias("run_words"), F.col("b.n_slots").alias("n_slots"), F.col("b.consistent").alias("consistent"), F.col("b.leak").alias("leak"),
        F.when(F.col("b.leak"), F.when(F.col("b.same_values"), "copied").otherwise("reparameterised")).alias("kind")))


def leaks(docs, benchmark, doc_id="doc_id", item_id="item_id", text="text"):
    """The leaks alone."""
    return judge(matches(docs, benchmark, doc_id, item_id, text)).where("leak").drop("leak")


def clean_documents(docs, benchmark, text="text"):
    """``docs`` without those that hold a leak. Rows are judged by their text, whatever their ids: each row on its own."""
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows = docs.select(key.alias("text_id"), F.col(text).alias("text"))
    bad = leaks(rows, benchmark, "text_id").select(F.col("doc_id").alias(free_name(docs, "leaking"))).distinct()
    return docs.join(bad, key == F.col(bad.columns[0]), "left_anti")
