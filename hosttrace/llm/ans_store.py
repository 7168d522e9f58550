"""Token ids in files coded by a static range asymmetric numeral system (rANS).

Layout of a store: ``model/`` holds one row with the shared frequency table; ``blocks/part=K/`` holds the blocks of the
K-th range of document ids, in ascending order within a file and, by the number in each block, between files. Blocks
are independent: the header lists the documents, their lengths and where decoding may begin (checkpoints), the body is
the coder's words; each has a CRC-32. Rows are written and read by Spark's text and binary readers, so a store may lie
wherever Spark can write; a line end follows each block.

Coding: 64-bit states, 32-bit words, frequencies scaled to 2^20 with at least one for each id. ``LANES`` states take
turns, one id each, so a step is a handful of numpy operations on all lanes. A checkpoint keeps the lanes' states and
the place in the words, every ``CHECKPOINT`` ids; decoding may start at each of them.

A document lies within one block, so a block is as large as ``BLOCK_IDS`` ids or its longest document.

Defined cases: a null text is empty and has the end id alone; a null doc_id comes first; rows with equal doc_id keep
the order of the written ids table; an empty table gives a store without blocks and a model of even frequencies.
"""

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from hosttrace.llm.common import materialize, scratch_dir
from hosttrace.llm.tokens import crc32, encoder, parts, tokenizer_path

SCALE_BITS = 20
LOWEST = np.uint64(1 << 31)
LANES = 1024
CHECKPOINT = 1 << 16
BLOCK_IDS = 1 << 18
BLOCKS_A_FILE = 128
MAGIC = b"RANS"
HEAD = struct.Struct("<4sIIIII")  # magic, header bytes, body bytes, ids, CRC of the header, CRC of the body


# ---------------------------------------------------------------- coder

def scaled_frequencies(counts):
    """Counts as frequencies that sum to 2^20, at least one each; what rounding leaves goes to the largest."""
    counts = np.asarray(counts, np.float64)
    total, room = counts.sum(), (1 << SCALE_BITS) - len(counts)
    if room < 0:
        raise ValueError("more symbols than the scale can hold")
    share = counts / total if total else np.full(len(counts), 1 / len(counts))
    freq = 1 + np.floor(share * room).astype(np.int64)
    freq[np.argmax(freq)] += (1 << SCALE_BITS) - freq.sum()
    return freq.astype(np.uint32)


class Coder:
    def __init__(self, freq):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - SCALE_BITS)
        self.symbol = None

    def encode(self, ids):
        """(checkpoints, words): checkpoints are (first id, place in the words, states) with the first at id 0."""
        n = len(ids)
        x = np.full(LANES, LOWEST, np.uint64)
        out, written, marks = [], 0, []
        shift, low = np.uint64(SCALE_BITS), np.uint64(0xFFFFFFFF)
        freq, start, limit = self.freq[ids], self.start[ids], self.limit[ids]
        for a in range((n - 1) // LANES * LANES, -1, -LANES):
            m = min(LANES, n - a)
            f, y = freq[a:a + m], x[:m]
            full = y >= limit[a:a + m]
            if full.any():
                words = (y[full] & low).astype(np.uint32)
                out.append(words[::-1])
                written += len(words)
                y = np.where(full, y >> np.uint64(32), y)
            d = y // f
            x[:m] = (d << shift) + (y - d * f) + start[a:a + m]
            if a % CHECKPOINT == 0:
                marks.append((a, written, x.copy()))
        words = np.concatenate(out)[::-1] if out else np.zeros(0, np.uint32)
        return [(a, written - w, s) for a, w, s in reversed(marks)], words

    def decode(self, states, words, n):
        """``n`` ids from a checkpoint's states and the words from its place on."""
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        x, at = states.copy(), 0
        out = np.empty(n, np.uint32)
        shift, mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
        for a in range(0, n, LANES):
            m = min(LANES, n - a)
            y = x[:m]
            slot = y & mask
            s = self.symbol[slot.astype(np.int64)]
            out[a:a + m] = s
            y = self.freq[s] * (y >> shift) + slot - self.start[s]
            empty = np.flatnonzero(y < LOWEST)
            if len(empty):
                y[empty] = (y[empty] << np.uint64(32)) | words[at:at + len(empty)].astype(np.uint64)
                at += len(empty)
            x[:m] = y
        return out


_coders = {}


def coder(table):
    """The coder of this worker for a frequency table given as bytes."""
    if table not in _coders:
        _coders.clear()
        _coders[table] = Coder(np.frombuffer(table, "<u4"))
    return _coders[table]


# ---------------------------------------------------------------- blocks

def write_block(c, part, number, doc_ids, lengths, ids):
    """Bytes of one block."""
    marks, words = c.encode(ids)
    missing = np.array([d is None for d in doc_ids], bool)
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = zlib.compress(struct.pack("<qqII", part, number, len(docs), len(marks)) + docs.tobytes()
                         + np.asarray(lengths, "<u4").tobytes() + np.packbits(missing).tobytes()
                         + b"".join(struct.pack("<II", a, w) + s.astype("<u8").tobytes() for a, w, s in marks), 1)
    body = words.astype("<u4").tobytes()
    return HEAD.pack(MAGIC, len(head), len(body), len(ids), zlib.crc32(head), zlib.crc32(body)) + head + body


def read_block(data, at=0):
    """The header of the block at ``at`` and where the next begins. The body stays coded."""
    magic, n_head, n_body, n, crc_head, crc_body = HEAD.unpack_from(data, at)
    a = at + HEAD.size
    head, body = data[a:a + n_head], data[a + n_head:a + n_head + n_body]
    if magic != MAGIC or zlib.crc32(head) != crc_head or zlib.crc32(body) != crc_body:
        raise ValueError("damaged block")
    head = zlib.decompress(head)
    part, number, n_docs, n_marks = struct.unpack_from("<qqII", head)
    p = 24
    docs = np.frombuffer(head, "<i8", n_docs, p)
    lengths = np.frombuffer(head, "<u4", n_docs, p + 8 * n_docs).astype(np.int64)
    p += 12 * n_docs
    missing = np.unpackbits(np.frombuffer(head, np.uint8, (n_docs + 7) // 8, p))[:n_docs].astype(bool)
    p += (n_docs + 7) // 8
    marks = []
    for _ in range(n_marks):
        a0, w = struct.unpack_from("<II", head, p)
        marks.append((a0, w, np.frombuffer(head, "<u8", LANES, p + 8).astype(np.uint64)))
        p += 8 + 8 * LANES
    return {"part": part, "number": number, "doc_ids": [None if m else int(d) for d, m in zip(docs, missing)],
            "lengths": lengths, "marks": marks, "words": np.frombuffer(body, "<u4"), "n": n}, at + HEAD.size + n_head + n_body


def decode_from(c, block, mark):
    """Ids between a checkpoint and the next; each can be decoded by itself."""
    a, w, states = block["marks"][mark]
    end = block["marks"][mark + 1][0] if mark + 1 < len(block["marks"]) else block["n"]
    return c.decode(states, block["words"][w:], end - a)


def decode_block(c, block):
    if not block["n"]:
        return np.zeros(0, np.uint32)
    return np.concatenate([decode_from(c, block, k) for k in range(len(block["marks"]))])


# ---------------------------------------------------------------- Spark

def encoded(docs, doc_id="doc_id", text="text", path=None):
    """Blocks of ids in ascending document order: (part, number, doc_ids, lengths, ids as 16-bit bytes).

    One range exchange deals texts by document id; encoding follows in the same task. A row's place in the input
    breaks ties, so a hot id spreads over ranges too.
    """
    path = path or tokenizer_path()
    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                           F.monotonically_increasing_id().alias("tie"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie"))

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        docs_, lengths, ids, held = [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([docs_], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([np.concatenate(ids).astype("<u2").tobytes()], pa.binary())],
                ["part", "number", "doc_ids", "lengths", "ids"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, texts in parts(batch.column(1)):
                got, sizes = encoder(path).encode(texts)
                first = 0
                for k, n in enumerate(sizes.tolist()):
                    docs_.append(names[at + k])
                    lengths.append(n)
                    ids.append(got[first:first + n])
                    first += n
                    held += n
                    if held >= BLOCK_IDS:
                        yield out()
                        number += 1
                        docs_, lengths, ids, held = [], [], [], 0
        if docs_:
            yield out()

    return ordered.select("doc_id", "text").mapInArrow(
        run, "part long, number long, doc_ids array<long>, lengths array<long>, ids binary")


def id_counts(blocks, vocabulary):
    """How often each id occurs, over all blocks; tasks add up theirs before anything is shuffled."""
    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_buffer(), "<u2"), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_store(docs, folder, doc_id="doc_id", text="text", path=None):
    """Encode ``docs`` and write the store. The driver holds the frequency table, bounded by the vocabulary."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    vocabulary = encoder(path).vocabulary
    blocks = materialize(encoded(docs, doc_id, text, path), "token-blocks")
    counts = np.zeros(vocabulary, np.int64)
    for row in id_counts(blocks, vocabulary).collect():
        counts[row["id"]] = row["n"]
    table = scaled_frequencies(counts).astype("<u4").tobytes()

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                data = write_block(coder(table), r["part"], r["number"], r["doc_ids"], r["lengths"], np.frombuffer(r["ids"], "<u2"))
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([r["part"]], pa.int64()), pa.array([r["number"]], pa.int64())],
                                                 ["data", "part", "number"])

    (blocks.mapInArrow(run, "data binary, part long, number long").sortWithinPartitions("part", "number")
     .select(F.col("data").cast("string").alias("value"), "part")
     .write.option("maxRecordsPerFile", BLOCKS_A_FILE).partitionBy("part").text(f"{folder}/blocks"))
    head = json.dumps({"bytes": len(table), "crc32": zlib.crc32(table)}).encode() + b"\n"
    model = spark.createDataFrame([(bytearray(head + table),)], "data binary").coalesce(1)
    model.select(F.col("data").cast("string").alias("value")).write.text(f"{folder}/model")
    return folder


def read_model(spark, folder):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/model").select("content").collect()
    data = bytes(files[0]["content"])
    head, _, table = data.partition(b"\n")
    head = json.loads(head)
    table = table[:head["bytes"]]
    if zlib.crc32(table) != head["crc32"]:
        raise ValueError("damaged model")
    return table


def read_store(spark, folder, with_ids=False):
    """(part, number, place, doc_id, n_tokens, ids_crc32[, ids]) of each document, decoded from the files."""
    table = read_model(spark, folder)
    schema = "part long, number long, place long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data, at = memoryview(content.as_buffer()), 0
                while at < len(data):
                    block, at = read_block(data, at)
                    at += 1  # the line end
                    ids, k = decode_block(coder(table), block), len(block["lengths"])
                    ends = np.cumsum(block["lengths"])
                    one = [ids[b - n:b] for b, n in zip(ends.tolist(), block["lengths"].tolist())]
                    cols = [pa.array([block["part"]] * k, pa.int64()), pa.array([block["number"]] * k, pa.int64()),
                            pa.array(np.arange(k)), pa.array(block["doc_ids"], pa.int64()),
                            pa.array(block["lengths"]), pa.array([crc32(x) for x in one], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype("<u4").tobytes() for x in one], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, ["part", "number", "place", "doc_id", "n_tokens", "ids_crc32", "ids"][:len(cols)])

    files = (spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{folder}/blocks"))
    return files.select("content").mapInArrow(run, schema)


def with_starts(read):
    """Adds ``start``: the ids of all documents before. Only one row for each part meets in one task."""
    blocks = read.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    parts_ = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    parts_ = parts_.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("of_part"))
    blocks = blocks.select("part", "number", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("of_block"))
    inside = Window.partitionBy("part", "number").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (read.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), zero))
            .join(blocks, ["part", "number"]).join(parts_, "part")
            .withColumn("start", F.col("of_part") + F.col("of_block") + F.col("inside")).drop("of_part", "of_block", "inside"))


def round_trip(docs, path=None):
    """Write a store in the shared scratch folder, read it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = write_store(docs, f"{scratch_dir(spark)}/token-store-{uuid.uuid4().hex}", path=path)
    read = materialize(read_store(spark, folder), "token-digests")
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
