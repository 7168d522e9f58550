"""Follow log files that grow: a streaming source with byte offsets.

``spark.readStream.format("growing_log").load(folder)`` gives (value, session, log, at): a record, the stem of its file's
name, the log it belongs to and the byte it starts at. Register the source first (``register(spark)``).

A log is known by its first ``identityRecords`` records, not by its name. So a file that is renamed when it rotates stays the log it was and is
not read again, a copy of it is the same log, and a file that is emptied and begun anew is a new log. Logs whose first
record is the same in every file (a header) need more of them. A record counts once its separator is there: the half line
a writer is in the middle of waits for a later batch.

The offset of a stream is {log: bytes}. Spark keeps it in the checkpoint, so after a restart every record arrives exactly
once. Ranges are cut into ``splitBytes``; a record belongs to the split it starts in, so a long backlog is read by many tasks, and
a task holds one block of ``BLOCK`` bytes and the record at its end.

Folders are reached through Arrow's file systems (local or mounted folders, HDFS, object stores) and must be the same for the
driver and the executors. Defined cases: an empty folder and empty files give nothing; a file that is gone before its
range was read fails the batch (the log would lose records silently otherwise); a file that comes back shorter under the
same first record waits until it is longer than what was read, and one that was away goes on where it was (both within a
run: a run that starts anew knows the logs that are there); bytes that are not UTF-8 are replaced.
"""

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 4 << 20
SPLIT = 64 << 20
HEAD = 1 << 20  # the records that name a log lie within so many bytes


def _place(path):
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _identity(files, path, size, separator, records):
    """A name for the log from its first records; None while they are not complete."""
    with files.open_input_file(path) as f:
        head, at = b"", -1
        for _ in range(records):
            at = head.find(separator, at + 1)
            while at < 0 and len(head) < min(size, HEAD):
                old = len(head)
                head += f.read(min(1 << 16, size - old))
                at = head.find(separator, max(0, old - len(separator)))
            if at < 0:
                return None
    return hashlib.sha256(head[:at]).hexdigest()[:32]


def _complete(files, path, size, separator):
    """The byte after the last separator before ``size``."""
    with files.open_input_file(path) as f:
        end = size
        while end > 0:
            start = max(0, end - (1 << 16))
            f.seek(start)
            # A separator may lie across the border of two blocks.
            block = f.read(min(size, end + len(separator) - 1) - start)
            k = block.rfind(separator)
            if k >= 0:
                return start + k + len(separator)
            end = start
    return 0


@dataclass
class Split(InputPartition):
    path: str
    log: str
    start: int
    end: int
    limit: int


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options):
        options = {k.lower(): v for k, v in options.items()}
        self.folder = options["path"]
        self.separator = options.get("linesep", "\n").encode()
        self.records = int(options.get("identityrecords", 1))
        self.split = int(options.get("splitbytes", SPLIT))
        self.seen = {}

    def _logs(self):
        """{log: (complete bytes, path)} of what lies in the folder; of copies the longest."""
        files, base = _place(self.folder)
        found = {}
        for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.type != fs.FileType.File or info.base_name.startswith((".", "_")) or not info.size:
                continue
            try:
                log = _identity(files, info.path, info.size, self.separator, self.records)
                end = _complete(files, info.path, info.size, self.separator) if log else 0
            except FileNotFoundError:  # renamed since it was listed
                continue
            if end and found.get(log, (0, ""))[0] < end:
                found[log] = (end, info.path)
        return found

    def initialOffset(self):
        return {}

    def latestOffset(self):
        self._note({log: end for log, (end, _) in self._logs().items()})
        return dict(sorted(self.seen.items()))

    def _note(self, offset):
        """A log never goes back, also if it is away for a while."""
        for log, end in offset.items():
            self.seen[log] = max(int(end), self.seen.get(log, 0))

    def partitions(self, start, end):
        self._note(start)
        wanted = {log: (int(start.get(log, 0)), int(to)) for log, to in end.items() if int(to) > int(start.get(log, 0))}
        there = self._logs() if wanted else {}
        out = []
        for log, (a, b) in wanted.items():
            if there.get(log, (0, ""))[0] < b:
                raise FileNotFoundError(f"a log of {self.folder} is gone before its bytes {a} to {b} were read")
            out += [Split(there[log][1], log, s, min(s + self.split, b), b) for s in range(a, b, self.split)]
        return out

    def read(self, partition):
        files, _ = _place(self.folder)
        path, separator = re.sub(r"^file:/+", "/", partition.path), self.separator
        name = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
        with files.open_input_file(path) as f:
            # A split after the first starts at the first record that begins in it; the one that runs in is its predecessor's.
            first = partition.start
            at = max(0, first - len(separator))
            f.seek(at)
            rest, skipping = b"", first > 0
            while at + len(rest) < partition.limit:
                block = f.read(min(BLOCK, partition.limit - at - len(rest)))
                if not block:
                    raise EOFError(f"{path} ends before byte {partition.limit}")
                data = rest + block
                if skipping:
                    k = data.find(separator)
                    if k < 0:
                        keep = min(len(separator) - 1, len(data))
                        at, rest = at + len(data) - keep, data[len(data) - keep:]
                        continue
                    at, data, skipping = at + k + len(separator), data[k + len(separator):], False
                values, places = [], []
                pieces = data.split(separator)
                for piece in pieces[:-1]:
                    if at >= partition.end:
                        break
                    values.append(piece[:-1] if separator == b"\n" and piece.endswith(b"\r") else piece)
                    places.append(at)
                    at += len(piece) + len(separator)
                if values:
                    text = [v.decode("utf-8", "replace") for v in values]
                    n = len(text)
                    yield pa.RecordBatch.from_arrays([pa.array(text), pa.array([name] * n), pa.array([partition.log] * n), pa.array(places, pa.int64())],
                                                     ["value", "session", "log", "at"])
                if at >= partition.end:
                    return
                rest = pieces[-1]


class GrowingLog(DataSource):
    @classmethod
    def name(cls):
        return "growing_log"

    def schema(self):
        return "value string, session string, log string, at long"

    def streamReader(self, schema):
        return GrowingLogReader(dict(self.options))


def register(spark):
    spark.dataSource.register(GrowingLog)


def tail(spark, folder, line_sep=None, identity_records=1, split_bytes=SPLIT):
    """The records of the logs in ``folder`` as a stream that follows them."""
    register(spark)
    reader = spark.readStream.format("growing_log").option("identityRecords", identity_records).option("splitBytes", split_bytes)
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    return reader.load(folder)
