"""WARC archives: writing with segmented records, and reassembly of segments on reading.

Writing: a page becomes an HTTP response in chunked transfer framing. A block over ``SEGMENT_BYTES`` is split: the first
record has WARC-Segment-Number 1, each further one is a ``continuation`` with the first one's id as
WARC-Segment-Origin-ID, and the last tells WARC-Segment-Total-Length. Of equal payloads all but that of the largest
page id become ``revisit`` records that name it. Archives are gzip files written by Spark's text writer, one record a
row with the blank lines that end a record as separator, so every store that Spark can write will do; a file holds at
most ``RECORDS_A_FILE`` records, which bounds what a reading task has in memory.

Reading: archives are read whole by Spark's binary reader and parsed record by record. Continuations are grouped by
origin, ordered by segment number, and joined if the numbers have no gap and the total length is right; then the chunked
framing is decoded and the payload digest verified. A group is one record's block, which is a single value of the result
anyway; records of one segment take no part in the grouping.

Defined cases: a null page is an empty payload; a null page_id is written as an empty id and read as null; rows that
repeat the largest page_id of a payload are all responses; rows with a null page_id revisit the largest id, and are
responses if their payload has no other; an empty table gives no archives; other columns are not written.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from hosttrace.llm.common import materialize, per_batch, scratch_dir, utf8

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
RECORDS_A_FILE = 4096
DATE = "2026-01-01T00:00:00Z"
END = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload, size=CHUNK_BYTES):
    """Chunked transfer framing of RFC 9112."""
    out = []
    for a in range(0, len(payload), size):
        part = payload[a:a + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body):
    """The payload of a chunked body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at:at + n])
        at += n + 2


def record(fields, block):
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def page_records(page_id, url, payload, refers_to, serial, known_digest=None, segment_bytes=SEGMENT_BYTES):
    """The record of a page, without the end marks: several if its block is over a segment."""
    page = "" if page_id is None else str(page_id)
    name = f"<urn:page:{page}:{serial}>"
    base = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", (url or "").replace("\r", "").replace("\n", "")),
            ("WARC-Payload-Digest", "sha1:" + (known_digest or digest(payload)))]
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), *base, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                        ("Content-Type", "application/http;msgtype=response")], REVISIT_HEAD)]
    block = HTTP_HEAD + chunked(payload)
    kind = [("WARC-Type", "response"), *base, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        return [record(kind, block)]
    parts = [block[a:a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    out = [record([*kind, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page}:{serial}:{n}>"), ("WARC-Date", DATE),
                           ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part))
    return out


def records_of(data):
    """(fields, block) of each record of an archive; field names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        a = end + 4
        b = a + int(fields["content-length"])
        if data[b:b + 4] != END:
            raise ValueError("record without its end")
        yield fields, data[a:b]
        at = b + 4


# ---------------------------------------------------------------- writing

def decisions(pages, page_id="page_id", page="html", least_bytes=0):
    """(page_id, sha, last): for each payload that occurs more than once, which page its other pages revisit.

    Payloads are digested in the JVM and pre-aggregated, so copies of one page cost a row for each task.
    """
    payload = F.coalesce(F.col(page), F.lit(""))
    return (pages.select(F.col(page_id).alias("id"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n"))
            .where(F.col("n") >= least_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.max("id").alias("last"))
            .where("copies > 1 AND last IS NOT NULL").select("sha", "last"))


def write_archives(pages, folder, page_id="page_id", url="url", page="html", least_bytes=0):
    """Write each row as a record (or its segments) under ``folder``."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("page"))
    rows = rows.withColumn("sha", F.sha1(F.col("page").cast("binary")))
    last = decisions(pages, page_id, page, least_bytes).withColumnRenamed("sha", "_sha")
    rows = (rows.join(last, F.col("sha") == F.col("_sha"), "left")
            .select("id", "url", "page", "sha", F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")))

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, urls, shas, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            out, size = [], 0
            for k, payload in enumerate(utf8(batch.column(2))):
                known = base64.b32encode(bytes.fromhex(shas[k])).decode()
                out += page_records(ids[k], urls[k], payload, refers[k], f"{part}-{serial}", known)
                serial += 1
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(folder))
    return folder


# ---------------------------------------------------------------- reading

def _inflated(data):
    """All members of a gzip file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


FIELDS = "record_id string, type string, url string, digest string, refers_to string, origin string, segment int, total long, block binary"


def read_records(spark, folder):
    """A row for each record of the archives of ``folder``."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                cols, size = [[] for _ in names], 0
                for f, block in records_of(_inflated(content.as_py())):
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    row = (f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:"),
                           f.get("warc-refers-to"), f.get("warc-segment-origin-id"), number and int(number), total and int(total), block)
                    for c, v in zip(cols, row):
                        c.append(v)
                    size += len(block)
                    if size > 8 << 20:
                        yield _records_batch(cols, names)
                        cols, size = [[] for _ in names], 0
                if cols[0]:
                    yield _records_batch(cols, names)

    files = (spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("pathGlobFilter", "part-*").load(folder))
    return files.select("content").mapInArrow(run, FIELDS)


def _records_batch(cols, names):
    kinds = {"segment": pa.int32(), "total": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(cols, names)], names)


def assemble(records):
    """(record_id, type, url, digest, refers_to, blocks) with the blocks of a record's segments in order.

    Raises an error for a missing segment or a wrong total length.
    """
    head = F.col("type") != "continuation"
    whole = records.where(head & F.col("segment").isNull()).select("record_id", "type", "url", "digest", "refers_to", F.array("block").alias("blocks"))
    parts = records.where(F.col("segment").isNotNull()).select(F.coalesce("origin", "record_id").alias("record_id"), "segment", "total", "block",
                                                              F.when(head, F.struct("type", "url", "digest", "refers_to")).alias("head"))
    grouped = parts.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
                                             F.max("head").alias("head"))
    joined = grouped.select("record_id", "head.*", F.transform("parts", lambda p: p["block"]).alias("blocks"), "total",
                            F.transform("parts", lambda p: p["segment"]).alias("numbers"))
    length = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b))
    sound = (length == F.col("total")) & F.col("type").isNotNull() & (F.col("numbers") == F.sequence(F.lit(1), F.size("numbers")))
    checked = joined.select("record_id", "type", "url", "digest", "refers_to", F.when(F.coalesce(sound, F.lit(False)), F.col("blocks"))
                            .otherwise(F.raise_error(F.concat(F.lit("incomplete segments of "), F.col("record_id")))).alias("blocks"))
    return whole.unionByName(checked)


def payloads(assembled):
    """(page_id, url, type, refers_to, digest, payload): framing decoded, digests of responses verified.

    A revisit has no payload of its own.
    """
    def one(batch):
        out = []
        for kind, said, blocks in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist()):
            if kind != "response":
                out.append(None)
                continue
            head, _, body = b"".join(blocks).partition(END)
            payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            if digest(payload) != said:
                raise ValueError("payload does not have its digest")
            out.append(payload)
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], ["record_id", "type", "url", "digest", "refers_to", "payload"])

    rows = assembled.mapInArrow(per_batch(one), "record_id string, type string, url string, digest string, refers_to string, payload binary")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]*)", 1).try_cast("long")
    return rows.select(number(F.col("record_id")).alias("page_id"), "url", "type", number(F.col("refers_to")).alias("refers_to"), "digest", "payload")


def round_trip(pages, least_bytes=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page from archives in the scratch folder.

    A revisit's length is that of the response it names.
    """
    spark = pages.sparkSession
    folder = write_archives(pages, f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}", least_bytes=least_bytes)
    read = payloads(assemble(read_records(spark, folder)))
    rows = materialize(read.select("page_id", "type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n")), "archived")
    responses = rows.where("type = 'response'")
    revisits = rows.where("type = 'revisit'").drop("n")
    named = revisits.select(F.col("refers_to").alias("id"), F.col("digest").alias("d")).distinct()
    named = responses.join(named, (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("d"))).groupBy("id", "d").agg(F.max("n").alias("n"))
    revisits = revisits.join(named, (F.col("refers_to") == F.col("id")) & (F.col("digest") == F.col("d")), "left").select(*rows.columns)
    return responses.unionByName(revisits).select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                                  F.col("type").alias("record_type"), "refers_to")
