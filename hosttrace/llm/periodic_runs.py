"""Periodic runs of words by recursive frequency splitting.

A run with period q has at least max(``LEAST``, ``POWER`` * q) words, so each of its words occurs ``POWER`` times or more in
every segment that holds the run, and ``LEAST`` times in a segment too short for two periods. Words that occur more rarely within
their segment split it; the pieces are judged again by their own counts until nothing splits. All pieces of a text are judged in step.
A text that still splits after ``DEPTH`` rounds is scanned as it is: splitting saves work and the scan is exact for any segment.

A surviving segment is scanned lag by lag. Every run of 4q words holds three whole blocks at multiples of q, so a lag
needs a look only at the block borders: consecutive blocks are compared by polynomial hashes of prefixes, which takes
m / q steps for a segment of m words and m log m for all lags together. A hit is stretched in both directions by binary
search on the hashes and then compared word by word, so a hash collision costs time and never a wrong run. A stretch
found at a smaller lag keeps that period: at four periods and more, every longer period of a stretch is a multiple of
the smallest.

Defined cases: a null or blank text has no words, no runs and hashes of empty text; ``wound`` leaves the words of a null
doc_id as they are; repeated rows stay; other columns are not read; texts of any length are taken whole.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hosttrace.llm.common import utf8

LEAST = 6
POWER = 4
ROWS_AT_ONCE = 512
DEPTH = 256

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def powers(n):
    """_BASE to the powers 0 .. n - 1 modulo 2^64; a table that grows by doubling."""
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_BASE, len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers[:n]


def wound(doc_id, words):
    """The words of one document, with a tail that repeats where the document's checksum says so."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


def segments(ids, least=LEAST, power=POWER):
    """[start, end) of the stretches that frequency splitting leaves."""
    n = len(ids)
    places = np.arange(n)
    piece = np.zeros(n, np.int64)
    for _ in range(DEPTH):
        if not len(places):
            return []
        # Two periods of two words or more need 2 * power words; a shorter piece holds runs of one word alone.
        size = np.bincount(piece)
        need = np.where(size < least, n + 1, np.where(size < 2 * power, least, min(least, power)))
        key = piece * n + ids[places]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        stay = count[back] >= need[piece]
        if stay.all():
            break
        places = places[stay]
        new = np.ones(len(places), bool)
        new[1:] = (np.diff(places) > 1) | (np.diff(piece[stay]) > 0)
        piece = np.cumsum(new) - 1
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(piece)) + 1
    return list(zip(places[np.concatenate([[0], cuts])].tolist(), (places[np.concatenate([cuts - 1, [-1]])] + 1).tolist()))


def _stretch(sums, n, i, j, q, back):
    """How many words before i and j (or from i and j on) are equal one by one, by hashes; never too few."""
    most = min(i, j) if back else n - j
    p = powers(q + 1)[q]
    low, high, step = 0, most, 1
    same = (lambda k: (sums[i] - sums[i - k]) * p == sums[j] - sums[j - k]) if back else (lambda k: (sums[i + k] - sums[i]) * p == sums[j + k] - sums[j])
    while low < high:  # gallop, then halve
        k = min(high, low + step)
        if same(k):
            low, step = k, step * 2
        else:
            high, step = k - 1, max(1, min(step, k - low) // 2)
    return low


def scan(x, least=LEAST, power=POWER):
    """{(start, end): smallest period} of the runs of one segment of word ids."""
    n = len(x)
    found = {}
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) * powers(n), dtype=np.uint64)])
        pw = powers(n + 1)
        for q in range(1, n // power + 1):
            block = sums[::q]
            block = block[1:] - block[:-1]
            equal = block[:-1] * pw[q] == block[1:]
            if q == 1:
                hits = np.flatnonzero(equal)
            else:
                hits = np.flatnonzero(equal[:-1] & equal[1:])
            end = -1
            for k in hits.tolist():
                i = k * q
                if i + q <= end:
                    continue
                j = i + q
                start = i - _stretch(sums, n, i, j, q, True)
                end = j + _stretch(sums, n, i, j, q, False)
                if (start, end) in found:
                    continue
                if not np.array_equal(x[start:end - q], x[start + q:end]):
                    unequal = np.flatnonzero(x[:n - q] != x[q:])
                    before, after = unequal[unequal < i], unequal[unequal >= i]
                    start, end = (int(before[-1]) + 1 if len(before) else 0), (int(after[0]) if len(after) else n - q) + q
                if end - start >= max(least, power * q):
                    found.setdefault((start, end), q)
    return found


def runs(words, least=LEAST, power=POWER):
    """(start, length, period) of every run of a list of words, by start, then period."""
    if len(words) < least:
        return []
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = []
    for a, b in segments(ids, least, power):
        out += [(a + s, e - s, q) for (s, e), q in scan(ids[a:b], least, power).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    """The words without what repeats inside a run: of each run its first period stays, unless another run drops it."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        drop[start + q] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs, doc_id="doc_id", text="text", least=LEAST, power=POWER, wind=wound):
    """(doc_id, n_runs, the longest run, digests of all runs and of the collapsed words) for each row.

    ``wind`` turns (doc_id, words) into the words that are searched; None searches the words as they are.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                rows = []
                for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                    words = t.split()
                    if wind is not None:
                        words = wind(i, words)
                    found = runs(words, least, power)
                    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
                    kept = hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()
                    rows.append((len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, digest, kept))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id"] + names)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
