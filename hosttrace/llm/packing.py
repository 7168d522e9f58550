"""Order-preserving packing: dynamic programming over document and sentence ends.

Documents keep the order they are read in. A task's token stream is cut into windows of at most ``width`` tokens; cuts
may fall at document ends (free) or sentence ends (``sentence_cost``), and, inside a stretch without any end for a
whole width, every ``width`` tokens (``hard_cost``). The cuts minimise padding plus these costs plus ``window_cost`` a
window. A window is padded to ``width``, unless its length is a power of two. With f(j) the least cost up to cut j,

    f(j) = cost(j) + width - p(j) + min over p(j) - width <= p(i) < p(j) of (f(i) + p(i))

so the minimum slides along a monotone queue; windows of a power of two are looked up directly.

The stream is worked off ``STREAM_TOKENS`` at a time; the last window stays open and goes before the next stretch, so
memory is bounded whatever a task or a document holds. No row is shuffled. Sequence numbers are the number of the
Spark partition times 2^33 plus a count, so a task that runs again after a lost executor gives the same rows.

Defined cases: a null or empty text has only the end id and is one piece of length 1; repeated rows are packed each
time; an empty table gives no pieces. Only the id and text columns are read.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from hosttrace.llm.tokens import crc32, encoder, parts, tokenizer_path

WIDTH = 2048
STREAM_TOKENS = 1 << 20


def sentence_ends(tokenizer):
    """Which ids end a sentence: pieces of punctuation alone with a full stop, question or exclamation mark."""
    ends = np.zeros(1 << 16, bool)
    for piece, i in tokenizer.get_vocab().items():
        core = piece.removesuffix("</w>")
        ends[i] = piece.endswith("</w>") and core != "" and not any(c.isalnum() for c in core) and any(c in ".!?" for c in core)
    return ends


def best_cuts(places, costs, width, window_cost):
    """Indexes of the chosen places (sorted positions from 0 to the end), the first and last included."""
    n = len(places)
    pairs = []
    mark = np.full(int(places[-1]) + 1, -1, np.int64)
    mark[places] = np.arange(n)
    size = 1
    while size < width:
        far = np.flatnonzero(places >= size)
        near = mark[places[far] - size]
        found = near >= 0
        pairs.append(np.stack([far[found], near[found]]))
        size *= 2
    pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    to, since = pairs[0].tolist() + [n], pairs[1].tolist()
    p, c = places.tolist(), costs.tolist()
    f, back = [0.0] * n, [0] * n
    queue, values, head, q = [0], [0.0], 0, 0
    for j in range(1, n):
        at = p[j]
        while at - p[queue[head]] > width:
            head += 1
        i, best = queue[head], values[head] + width - at
        while to[q] == j:
            if f[since[q]] < best:
                i, best = since[q], f[since[q]]
            q += 1
        f[j], back[j] = best + c[j] + window_cost, i
        value = f[j] + at
        while len(queue) > head and values[-1] >= value:
            queue.pop()
            values.pop()
        queue.append(j)
        values.append(value)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def cut_places(ids, doc_ends, is_end, width, sentence_cost, hard_cost):
    """Where a stream may be cut, and at what cost."""
    total = len(ids)
    cost = {}
    sentence = np.flatnonzero(is_end[ids]) + 1
    known = np.union1d(np.union1d(sentence, doc_ends), [0, total])
    gaps = np.flatnonzero(np.diff(known) > width)
    hard = [np.arange(known[g] + width, known[g + 1], width) for g in gaps]
    places = np.union1d(known, np.concatenate(hard)) if hard else known
    cost = np.full(len(places), float(hard_cost))
    cost[np.searchsorted(places, known)] = sentence_cost
    cost[np.searchsorted(places, np.union1d(doc_ends, [0, total]))] = 0
    return places.astype(np.int64), cost


def pack(docs, doc_id="doc_id", text="text", width=WIDTH, sentence_cost=4.0, hard_cost=64.0, window_cost=8.0, path=None):
    """One row for each piece: its document, place in it, sequence and place there, and a checksum of its ids."""
    path = path or tokenizer_path()
    id_type = docs.schema[doc_id].dataType.simpleString()
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "used"]

    def run(batches):
        tool = encoder(path)
        is_end = sentence_ends(tool.tokenizer)
        number = TaskContext.get().partitionId() << 33
        stream, owners, held = [], [], 0  # owners: (document, its ids before, length here, its ids)
        id_values = None

        def flush(last):
            nonlocal stream, owners, held, number
            ids = np.concatenate(stream)
            lengths = np.array([o[2] for o in owners])
            upto = np.cumsum(lengths)
            whole = np.array([o[1] + o[2] == o[3] for o in owners])
            places, cost = cut_places(ids, upto[whole], is_end, width, sentence_cost, hard_cost)
            cuts = places[best_cuts(places, cost, width, window_cost)]
            if not last:
                cuts = cuts[:-1]
            rows, k = [], 0
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = a
                while at < b:
                    while upto[k] <= at:
                        k += 1
                    doc, before, length, doc_tokens = owners[k]
                    inside = at - (int(upto[k]) - length)
                    n = min(b, int(upto[k])) - at
                    rows.append((doc, before + inside, n, crc32(ids[at:at + n]), doc_tokens, number, at - a, b - a))
                    at += n
                number += 1
            rest = int(cuts[-1])
            left = []
            for (doc, before, length, doc_tokens), end in zip(owners, upto.tolist()):
                if end > rest:
                    skip = max(0, rest - (end - length))
                    left.append((doc, before + skip, length - skip, doc_tokens))
            stream, owners, held = [ids[rest:]], left, len(ids) - rest
            return rows

        def out(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_values), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                              ["doc_id", *columns])

        for batch in batches:
            id_values = batch.column(0).type
            names = batch.column(0).to_pylist()
            for at, part in parts(batch.column(1)):
                ids, sizes = tool.encode(part)
                first = 0
                for k, n in enumerate(sizes.tolist()):
                    done = 0
                    while done < n:
                        take = min(n - done, STREAM_TOKENS)
                        stream.append(ids[first + done:first + done + take])
                        owners.append((names[at + k], done, take, n))
                        held += take
                        done += take
                        if held >= STREAM_TOKENS and (rows := flush(False)):
                            yield out(rows)
                    first += n
        if held and (rows := flush(True)):
            yield out(rows)

    schema = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in columns)
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)
