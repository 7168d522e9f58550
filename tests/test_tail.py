"""A followed log: every complete record once, through growth, half lines, rotation, copies, truncation and restarts."""

import pytest

from hosttrace.sources import tail


def reader(folder, **options):
    return tail.GrowingLogReader({"path": str(folder), **options})


def batch(folder, start, **options):
    """A fresh reader, as after a restart: (records of the next batch, its offset)."""
    r = reader(folder, **options)
    end = r.latestOffset()
    rows = [(v, at) for p in r.partitions(start, end) for b in r.read(p) for v, at in zip(b.column(0).to_pylist(), b.column(3).to_pylist())]
    return [v for v, _ in sorted(rows, key=lambda x: x[1])], end


def test_growth_half_lines_and_rotation(tmp_path):
    log = tmp_path / "a.log"
    assert batch(tmp_path, {}) == ([], {})
    log.write_bytes(b"first\r\nsecond\nhal")
    rows, at = batch(tmp_path, {})
    assert rows == ["first", "second"]
    with log.open("ab") as f:
        f.write(b"f a line\n\xff\xfethird\n")
    rows, at = batch(tmp_path, at)
    assert rows == ["half a line", "��third"]
    with log.open("ab") as f:
        f.write(b"late\n")
    log.rename(tmp_path / "a.log.1")  # rotated with something unread in it
    log.write_bytes(b"new log\n")
    (tmp_path / "copy.log").write_bytes((tmp_path / "a.log.1").read_bytes())
    rows, at = batch(tmp_path, at)
    assert sorted(rows) == ["late", "new log"]
    log.write_bytes(b"emptied and begun anew\nx")
    (tmp_path / "_hidden").write_bytes(b"no\n")
    (tmp_path / "empty.log").write_bytes(b"")
    assert batch(tmp_path, at)[0] == ["emptied and begun anew"]


@pytest.mark.parametrize("separator", ["\n", "</Event>"])
@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_splits_meet_every_record_once(tmp_path, split, separator, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 5)
    records = ["", "a", "x" * 100, "<Event>", "é", "", "</Even", "z"] * 5
    (tmp_path / "a.log").write_bytes(("head" + separator + separator.join(records) + separator + "rest").encode())
    rows, _ = batch(tmp_path, {}, lineSep=separator, splitBytes=split)
    assert rows == ["head", *records]


def test_headers_and_lost_logs(tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.log").write_text(f"#header\n{k}\nmore\n")
    assert len(batch(tmp_path, {})[1]) == 1  # one header, one log
    rows, at = batch(tmp_path, {}, identityRecords=2)
    assert sorted(rows) == ["#header", "#header", "0", "1", "more", "more"] and len(at) == 2
    r = reader(tmp_path, identityRecords=2)
    assert r.partitions(at, at) == []
    (tmp_path / "0.log").unlink()
    with pytest.raises(FileNotFoundError):
        r.partitions({}, at)


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    for step in ("one\ntwo\nthr", "ee\nfour\n", ""):
        with (folder / "x.log").open("a") as f:
            f.write(step)
        (tail.tail(spark, str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
         .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(out).collect()
    assert sorted(r["value"] for r in rows) == ["four", "one", "three", "two"] and {r["session"] for r in rows} == {"x"}


def test_options_reach_the_reader_and_logs_never_go_back(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    (folder / "x.log").write_text("<a/></Event><b>\n</b></Event><c")
    (tail.tail(spark, str(folder), line_sep="</Event>").writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
     .trigger(availableNow=True).start().awaitTermination())
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == ["<a/>", "<b>\n</b>"]
    r = reader(folder)
    first = r.latestOffset()
    (folder / "x.log").rename(tmp_path / "away")
    assert r.latestOffset() == first and r.partitions(first, first) == []
