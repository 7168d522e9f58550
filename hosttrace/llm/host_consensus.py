"""Main text of pages by the consensus of a host.

First pass: each page's containers are scored by the text they hold, less link text, with weights for their tag and
class, and the page votes for the generalised path (tags with classes, digits removed) of its best container. Votes are
added up per host in Spark; pages of one task are added up before they are shuffled, so a hot host costs no more than
its distinct paths. Second pass: each page is read again with its host's ``PATHS`` paths of most votes; the first of them whose
outermost containers hold at least ``ENOUGH`` of the text of the page's own best container gives the text. A page without such a
path falls back to its own best container, so a host may have several templates.

Within containers, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out by tag, role or class. A class counts only if it names the thing itself: a word joined with a state ("has-sidebar",
"comments-open") does not. A container named so is kept all the same if it holds an article or main element or, on a page without one and
comments aside, more than half of the text; and a page that comes out empty is read again without class rules. Blocks are joined by two
line ends; white space inside a block is one blank.

Defined cases: a null or empty page has an empty text; pages with a null or hostless url do not vote and use their own best container; repeated
rows give repeated results; truncated or unbalanced markup ends where the text ends (an unclosed script or style takes the
rest, any other unclosed element its tag alone); other columns are not read.
"""

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from hosttrace.llm.common import materialize, texts

BROADCAST_HOSTS = 20_000  # rows of a host and its paths, some 500 bytes each
PATHS = 4
ENOUGH = 0.5

# Element kinds of HTML and words by which boilerplate is named.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg select".split())
TO_THE_END = frozenset("script style".split())
OMITTED = frozenset("nav footer aside form button dialog menu head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time "
                   "tt u var wbr img br math mi mn mo ms mtext mrow mfrac msup msub msqrt mroot semantics".split())
CONTAINERS = frozenset("article main section div td body center".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr", "th": "tr", "option": "select"}
BAD_WORDS = frozenset("""ad ads advert adverts advertisement advertising adbox sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal
    nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar comment comments reply replies discussion disqus respond
    share sharing social related recommended newsletter subscribe signup login widget widgets pagination pager""".split())
COMMENT_WORDS = frozenset("comment comments reply replies discussion disqus respond".split())
STATE_WORDS = frozenset("has have with without no not is are open opened closed fixed sticky enabled disabled show shows hide hides on off".split())
GOOD_WORDS = frozenset("article content main post entry story body text".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TELLING = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
_PARTS = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def host_of(url):
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class Node:
    __slots__ = ("tag", "path", "omit", "named", "holds", "comments", "parent", "weight", "index")

    def __init__(self, tag, path, omit, named, comments, parent, weight, index):
        self.tag, self.path, self.omit, self.parent, self.weight, self.index = tag, path, omit, parent, weight, index
        self.named, self.comments, self.holds = named, comments, False  # omitted by its name; named for comments; holds an article


def _named(attributes):
    """(classes and id as words, role, hidden)."""
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    names = f"{found.get('class', '')} {found.get('id', '')}"
    hidden = "hidden" in attributes.lower().split() or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return names, found.get("class", ""), found.get("role", "").lower(), hidden


def _words(names):
    return {w for n in names.split() for w in _PARTS.findall(_CAMEL.sub("-", n).lower())}


def _bad_words(names):
    """Words of boilerplate in the classes and ids that name the thing itself."""
    out = set()
    for n in names.split():
        words = set(_PARTS.findall(_CAMEL.sub("-", n).lower()))
        if not words & STATE_WORDS:
            out |= words & BAD_WORDS
    return out


def _settled(every, pieces):
    """Decide what is omitted by name, outer nodes first, and leave out its pieces."""
    if any(x.named for x in every):
        size, total = {}, 0
        for node, _, t, linked in pieces:
            k = 0 if linked else len(t) - t.count(" ") - t.count("\n")
            total += k
            x = node if k else None
            while x is not None:
                if x.named:
                    size[id(x)] = size.get(id(x), 0) + k
                x = x.parent
        for x in every:
            kept = x.holds or not every[0].holds and not x.comments and size.get(id(x), 0) * 2 > total
            x.omit = x.omit or x.parent is not None and x.parent.omit or x.named and not kept
    return [p for p in pieces if not p[0].omit]


def parse(page, by_name=True):
    """(nodes, pieces): pieces are (node, block, text, linked) in page order; block numbers grow at block ends."""
    root = Node("", "", False, False, False, None, 1.0, 0)
    every = [root]
    nodes, stack, pieces, block, at, n = [root], [root], [], 0, 0, len(page)
    links = 0
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not stack[-1].omit:
            pieces.append((stack[-1], block, page[at:end], links > 0))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br" or tag == "p" and not any(x.tag == "p" for x in stack):
                if tag == "p":
                    block += 1
                continue
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if not k:
                continue
            if tag in INLINE:
                # An inline end does not close blocks that were opened since.
                if any(x.tag not in INLINE for x in stack[k + 1:]):
                    continue
            for x in stack[k:]:
                links -= x.tag == "a"
            del stack[k:]
            if tag not in INLINE:
                block += 1
            continue
        if tag == "br":
            if not stack[-1].omit:
                pieces.append((stack[-1], block, " ", links > 0))
            continue
        if tag in VOID:
            block += tag == "hr"
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            close = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n if tag in TO_THE_END else at
            continue
        if tag in CLOSES_P:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p" or stack[k].tag in ("td", "th", "button")), 0)
            if k and stack[k].tag == "p":
                for x in stack[k:]:
                    links -= x.tag == "a"
                del stack[k:]
                block += 1
        elif tag in SIBLINGS:
            scope = SIBLINGS[tag].split()
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same:
                    for x in stack[k:]:
                        links -= x.tag == "a"
                    del stack[k:]
                    break
                if stack[k].tag in scope:
                    break
        if tag not in INLINE:
            block += 1
        up = stack[-1]
        names, classes, role, hidden = _named(m[3]) if _TELLING.search(m[3]) else ("", "", "", False)
        words = _words(names) if names.strip() else frozenset()
        shell = tag in ("html", "body")
        bad = not shell and (tag in OMITTED or role in BAD_ROLES or hidden)
        wrong = _bad_words(names) if by_name and not shell and words & BAD_WORDS and not (tag in ("article", "main") and words & GOOD_WORDS) else ()
        if tag == "header" and not any(x.tag in ("article", "main") for x in stack):
            bad = True
        if tag in ("article", "main") and not up.omit and not bad:
            for x in stack:
                x.holds = True
        named, comments = bool(wrong), bool(wrong) and not COMMENT_WORDS.isdisjoint(wrong)
        if tag in INLINE:
            node = Node(tag, up.path, up.omit or bad, named, comments, up, 0, up.index)
        else:
            kind = ".".join([tag, *sorted(re.sub(r"\d+", "", c) for c in classes.split())]) if classes else tag
            weight = (2.0 if tag in ("article", "main") or role in ("article", "main") else 1.5 if words & GOOD_WORDS else 1.0) if tag in CONTAINERS else 0
            node = Node(tag, f"{up.path}>{kind}", up.omit or bad, named, comments, up, weight, len(nodes))
            nodes.append(node)
        every.append(node)
        stack.append(node)
        links += tag == "a"
        if m[3].endswith("/") and tag not in INLINE:
            stack.pop()
    return nodes, _settled(every, pieces)


def best_container(nodes, pieces):
    """The node with the best score. A block's text counts for its container, less for each one further out."""
    text, score = {}, {}
    for node, _, t, linked in pieces:
        k = len(t) - t.count(" ") - t.count("\n")
        if k > 0:
            text[node.index] = text.get(node.index, 0) + (-k if linked else k)
    for i, k in text.items():
        x, share = nodes[i], 1.0
        while x is not None:
            if x.weight and not x.omit:
                score[x.index] = score.get(x.index, 0.0) + k * share * x.weight
                share *= 0.6
            x = x.parent
    if not score:
        return None
    best = max(score, key=lambda i: (score[i], -i))
    return nodes[best] if score[best] > 0 else None


def _text(pieces, inside):
    blocks, last = [], None
    for node, block, t, _ in pieces:
        if inside(node):
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(t)
    out = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(b for b in out if b)


def _under(chosen):
    memory = {}

    def inside(node):
        i = node.index
        if i not in memory:
            x = node
            while x is not None and x.index not in chosen:
                x = x.parent
            memory[i] = x is not None
        return memory[i]
    return inside


def read(page):
    """(nodes, pieces, best container or None), without name rules where they leave nothing."""
    nodes, pieces = parse(page)
    best = best_container(nodes, pieces)
    if best is None:
        nodes, pieces = parse(page, by_name=False)
        best = best_container(nodes, pieces)
    return nodes, pieces, best


def extract(page, paths=()):
    """(text, path used, whether it is one of the given ones)."""
    nodes, pieces, best = read(page)
    if best is None:
        return "", None, False
    own = _text(pieces, _under({best.index}))
    for path in paths or ():
        if path == best.path and sum(x.path == path for x in nodes) == 1:
            return own, path, True
        chosen = {x.index for x in nodes if x.path == path and not x.omit}
        text = _text(pieces, _under(chosen)) if chosen else ""
        if text and len(text) >= ENOUGH * len(own):
            return text, path, True
    return own, best.path, False


def votes(pages, url="url", page="html"):
    """(host, path, n) with n the pages of the host whose best container has that path."""
    def run(batches):
        for batch in batches:
            found = Counter()
            for u, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                host = host_of(u)
                best = read(t)[2] if host else None
                if best is not None and best.path:  # the page as a whole is no path to share
                    found[host, best.path] += 1
            if found:
                keys = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(list(found.values()), pa.int64())],
                                                 ["host", "path", "n"])

    return pages.select(F.col(url), F.col(page)).mapInArrow(run, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))


def winning_paths(counted):
    """(host, winners): the ``PATHS`` paths with the most votes; of equals the shorter, then the greater one first.

    One pass a place: each takes the best path below the last one, so a host's paths never gather in one list.
    """
    order = F.struct("n", (-F.length("path")).alias("short"), F.col("path"))
    ranked = counted.select("host", order.alias("o"))
    winners = ranked.groupBy("host").agg(F.max("o").alias("last")).withColumn("winners", F.array("last.path"))
    for _ in range(PATHS - 1):
        left = ranked.join(winners.select("host", "last"), "host").where(F.col("o") < F.col("last")).groupBy("host").agg(F.max("o").alias("next"))
        winners = winners.join(left, "host", "left").select("host", F.coalesce("next", "last").alias("last"), F.when(
            F.col("next").isNull(), F.col("winners")).otherwise(F.concat("winners", F.array("next.path"))).alias("winners"))
    return winners.select("host", "winners")


def extract_main_text(pages, page_id="page_id", url="url", page="html"):
    """(page_id, url, text, n_chars, path, by_consensus) for each row.

    Winners, a row for each host, are written and counted: up to ``BROADCAST_HOSTS`` they go to the pages, which then
    stay where they are read. With more hosts pages meet them in an equi-join; the pages are the left side of a left
    join, so Spark can split a hot host's rows.
    """
    winners = materialize(winning_paths(materialize(votes(pages, url, page), "votes")).withColumnRenamed("host", "_host"), "host-paths")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("page"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = rows.join(winners, host == F.col("_host"), "left").select("page_id", "url", "page", "winners")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for batch in batches:
            got = [extract(t, w) for t, w in zip(texts(batch.column(2)), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.bool_())],
                ["page_id", "url", "text", "n_chars", "path", "by_consensus"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, path string, by_consensus boolean")
