"""Archives and page text."""

import base64
import gzip
import hashlib
import random
import uuid
from html.parser import HTMLParser

import pytest

from hosttrace.llm import host_consensus, warc_segments
from hosttrace.llm.common import scratch_dir


def pages(spark, rows):
    full = [(i, u, h, "a", "b", 1) for i, u, h in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, path string, record string, sha int").repartition(3)


def bodies():
    r = random.Random(4)
    return ["".join(r.choice("abc\r\né0\x00") for _ in range(n)) for n in (0, 1, 10, 8191, 8192, 40_000, 200_000)]


def test_chunked_framing():
    for n in (0, 1, 8192, 8193, 30_000):
        body = random.Random(n).randbytes(n)
        assert warc_segments.dechunked(warc_segments.chunked(body)) == body
    assert warc_segments.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc_segments.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc_segments, "RECORDS_A_FILE", 3)
    b = bodies()
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(b)] + [(20, None, None), (21, "http://x\r\n", b[6]), (9, "u", b[6]), (21, "again", b[6]),
                                                              (None, "n", "only"), (None, "n", b[5]), (30, "z", b[2])]
    got = sorted(map(tuple, warc_segments.round_trip(pages(spark, rows)).collect()), key=repr)
    want, last = [], {}
    for i, _, t in rows:
        if i is not None:
            last[t or ""] = max(last.get(t or "", -1), i)
    for i, _, t in rows:
        data = (t or "").encode()
        to = last.get(t or "")
        first = to is None or i == to
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else to))
    assert got == sorted(want, key=repr)
    assert warc_segments.round_trip(pages(spark, rows).limit(0)).collect() == []


def test_payloads_and_damage(spark):
    b = bodies()
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc_segments.write_archives(pages(spark, [(k, f"http://h/{k}", t) for k, t in enumerate(b)]), folder)
    records = warc_segments.read_records(spark, folder).cache()
    assert records.where("type = 'continuation'").count() > 5
    got = {r["page_id"]: (r["payload"].decode(), r["url"]) for r in warc_segments.payloads(warc_segments.assemble(records)).collect()}
    assert got == {k: (t, f"http://h/{k}") for k, t in enumerate(b)}
    with pytest.raises(Exception, match="incomplete segments"):
        warc_segments.assemble(records.where("segment IS NULL OR segment <> 2")).collect()


def test_archives_are_plain_warc(spark):
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc_segments.write_archives(pages(spark, [(1, "http://h/1", "hello")]), folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()
    data = b"".join(gzip.decompress(f["content"]) for f in files)
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"0\r\n\r\n\r\n\r\n") and b"\r\n5\r\nhello\r\n" in data


# ---------------------------------------------------------------- page text

PAGE = """<!doctype html><html><head><title>T</title><style>p{x}</style><script>var a="</p><p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">Cookies!</div>
<div class="wrap"><div class="story s%d"><h1>Head &amp; tail</h1><p>One <b>bold</b>
 text &#233;&lt;3<br>next<p>Two<ul><li>x<li>y</ul><!-- <p>hidden</p> --><form>Name</form><div class="ad">Buy</div>
<aside>Side</aside></div><div class="comments"><p>%s</p></div></div><footer>&copy;</footer></body>"""
TEXT = "Head & tail\n\nOne bold text é<3 next\n\nTwo\n\nx\n\ny"


@pytest.mark.parametrize("hosts", [50_000, 0])
def test_consensus(spark, hosts, monkeypatch):
    monkeypatch.setattr(host_consensus, "BROADCAST_HOSTS", hosts)
    odd = "<html><body><div class='wrap'><div class='story s9'><p>short</p></div><div class='box'><p>" + "long other text " * 40 + "</p></div></div></body></html>"
    rows = [(k, f"https://u@Host.example:8080/{k}?q=//x", PAGE % (k, "comment " * 50)) for k in range(6)] + [(7, "http://host.example/7", odd)]
    rows += [(8, None, odd), (9, "not a url", ""), (10, "http://other/", None), (10, "http://other/", None), (11, "http://host.example/", "<p>plain <nav>x"), (12, "http://h2/", "a < b &amp c")]
    got = {r["page_id"]: r for r in host_consensus.extract_main_text(pages(spark, rows)).collect()}
    assert all(got[k]["text"] == TEXT and got[k]["by_consensus"] and got[k]["n_chars"] == len(TEXT) for k in range(6))
    assert "long other text" in got[7]["text"]  # the host's path holds a teaser alone
    assert got[8]["text"].startswith("long other text") and got[9]["text"] == "" and got[10]["n_chars"] == 0
    assert got[11]["text"] in ("plain", "") and len(got) == 12
    assert host_consensus.extract_main_text(pages(spark, rows).limit(0)).collect() == []


def test_winners_break_ties(spark):
    counted = spark.createDataFrame([("h", "a>b", 3), ("h", "a", 3), ("h", "c", 3), ("g", "z", 1)], "host string, path string, n long")
    assert {(r[0], *r[1]) for r in host_consensus.winning_paths(counted).collect()} == {("h", "c", "a", "a>b"), ("g", "z")}
    many = spark.createDataFrame([("h", f"p{k}", k) for k in range(9)], "host string, path string, n long")
    assert [r[1] for r in host_consensus.winning_paths(many).collect()] == [["p8", "p7", "p6", "p5"]]


class Walker(HTMLParser):
    """Text blocks of well-formed pages below the element marked data-main, without elements marked data-skip."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img"):
            self.open.append((tag, dict(attrs)))
        if tag not in ("b", "i", "math", "mi"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.open.pop()
        if tag not in ("b", "i", "math", "mi"):
            self.blocks.append("")

    def handle_data(self, data):
        names = [a for _, attrs in self.open for a in attrs]
        if "data-main" in names and "data-skip" not in names:
            self.blocks[-1] += data

    @classmethod
    def text(cls, page):
        w = cls()
        w.feed(page)
        return "\n\n".join(" ".join(b.split()) for b in w.blocks if b.strip())


STORY = "".join(f"<p>Paragraph {k} of a <b>story</b> that says some{k}thing about the harbour and the stones on its quay.</p>" for k in range(8))
REST = "<div class='sidebar' data-skip><p>Side text here</p></div><div class='comments' data-skip>" + "<p>A reader writes that this is long.</p>" * 20 + "</div>"
WRAPPERS = [("div", "class='content has-sidebar'"), ("div", "class='post-body with-comments'"), ("div", "class='site right-sidebar'"), ("article", "class='comments-open'"),
            ("section", "class='social-policy'"), ("div", "id='main' class='header-fixed'"), ("div", "class='no-menu layout'"), ("div", "class='text'"), ("main", "class='page'")]


@pytest.mark.parametrize("tag, names", WRAPPERS)
@pytest.mark.parametrize("inner", ["", "<figure><figcaption>What one sees</figcaption></figure>", "<noscript><p>Plain words</p></noscript>", "<p>Area is <math><mi>x</mi></math> here</p>",
                                   "<div class='advert' data-skip><p>Buy now</p></div>", "<div class='share-buttons' data-skip><p>Share it</p></div>"])
def test_extract_equals_a_plain_walker(tag, names, inner):
    page = f"<html><body><nav data-skip><p>Home</p></nav><{tag} {names} data-main><h1>Title</h1>{STORY}{inner}</{tag}>{REST}</body></html>"
    assert host_consensus.extract(page)[0] == Walker.text(page)
    within = f"<html><body><{tag} {names} data-main><h1>Title</h1>{STORY}{inner}{REST}</{tag}></body></html>"
    assert host_consensus.extract(within)[0] == Walker.text(within)


def test_unclosed_elements_and_name_rules_alone():
    page = f"<html><body><svg><div class='text' data-main>{STORY}</div></body></html>"
    assert host_consensus.extract(page)[0] == Walker.text(page.replace("<svg>", ""))
    only = f"<html><body><div class='comments' data-main>{STORY}</div></body></html>"
    assert host_consensus.extract(only)[0] == Walker.text(only)  # nothing else is there


def test_two_templates_of_a_host(spark):
    """A minority template uses the winner's path for a teaser."""
    first = f"<html><body><div class='lead' data-main>{STORY}</div></body></html>"
    second = "<html><body><div class='lead'><p>Read more of it</p></div><div class='deep' data-main>%s</div></body></html>" % (STORY * 2)
    rows = [(k, "http://h/", first) for k in range(9)] + [(k, "http://h/", second) for k in range(9, 13)] + [(k, None, second) for k in range(13, 15)]
    got = {r["page_id"]: r for r in host_consensus.extract_main_text(pages(spark, rows)).collect()}
    assert all(got[k]["text"] == Walker.text(p) for k, _, p in rows)
    assert all(got[k]["by_consensus"] == (k < 13) for k in got)


def test_long_and_broken_pages():
    deep = "<div>" * 3000 + "text" + "<p>" * 10
    assert host_consensus.extract(deep)[0] == "text"
    assert host_consensus.extract("<p>a</b></i></p></p>b<" + "x" * 100_000)[0].startswith("a\n\nb")
    assert host_consensus.extract("<script>never closed")[0] == ""
