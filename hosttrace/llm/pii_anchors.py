"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, schemes, plus signs before a digit, two digits with at
most a blank or hyphen between, digit-dot-digit, and cue words for accounts. From each anchor a deterministic parser for
its kind walks left and right to the boundaries and validates what it finds: no pattern is tried elsewhere.

Base kinds (email, ip, card, phone) follow fixed grammars, leftmost and without overlap within a kind; a match that
fails validation is dropped and not tried again. Added kinds:

* ``account``: an account number after a cue (IBAN with a valid mod-97 remainder, US social security numbers with valid groups, 6 to 17 digits
  after a word for an account, 9 after one for a routing number),
* ``url``: a URL that carries user information (scheme://user:secret@host),
* ``address``: an email address spelled with (at) and (dot) in brackets,
* ``secret``: what stands after a word for a key, token or password and a colon or equals sign; unless quoted, with letters and digits.

Cues are found without regard to case. Every parser stops where the next anchor of its kind could begin or moves past
what it has read, so time is linear in the text. Spans are code points, the end exclusive. Text is read whole, whatever its length.

Defined cases: a null or empty text has no spans; repeated rows give repeated results; other columns are not read.
"""

import hashlib
import re
from string import digits

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

from hosttrace.llm.common import per_batch, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url", "address", "secret")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGITS = frozenset(digits)
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
HOST = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
# Cues and schemes that open a search for an account number or a URL.
IBAN_CUES = ("iban",)
SSN_CUES = ("ssn", "social security")
ACCOUNT_CUES = ("account no", "account number", "account #", "acct", "a/c no", "kontonummer")
ROUTING_CUES = ("routing no", "routing number")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key", "private_key")
SCHEMES = ("ftp://", "http://", "https://", "ssh://")
AT_WORDS = ("(at)", "[at]")
_SMALL = {c: c + 32 for c in range(65, 91)}  # A-Z alone, so that places stay


def automaton():
    """Anchors and the parser each belongs to."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for d in digits:
        a.add_word("+" + d, ("phone", 2))
        for e in digits:
            a.add_word(d + "." + e, ("ip", 3))
            for gap in ("", " ", "-"):
                a.add_word(d + gap + e, ("card", 2 + len(gap)))
    for cues, kind in ((IBAN_CUES, "iban"), (SSN_CUES, "ssn"), (ACCOUNT_CUES, "number"), (ROUTING_CUES, "routing"), (SECRET_CUES, "secret"),
                       (SCHEMES, "url"), (AT_WORDS, "address")):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


_AUTOMATON = automaton()


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_valid(number):
    """ISO 13616: 15 to 34 characters, country, two check digits, remainder 1 modulo 97."""
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", number):
        return False
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


# ---------------------------------------------------------------- parsers
# Each takes the text, the anchor's start and end, and where the last match of its kind ended. It returns
# (start, end, valid), or None where its grammar does not match at all.

def _email(t, a, b, after):
    s = a
    while s > after and t[s - 1] in LOCAL:
        s -= 1
    if s == a:
        return None
    e, n, dots = b, len(t), 0
    while e < n and t[e] in HOST:
        e += 1
    if e == b:
        return None
    while e + 1 < n and t[e] == "." and t[e + 1] in HOST:
        e += 2
        while e < n and t[e] in HOST:
            e += 1
        dots += 1
    return (s, e, True) if dots else None


def _ip(t, a, b, after):
    s = a
    while s > after and (t[s - 1] in DIGITS or t[s - 1] == "." and s - 1 > after and t[s - 2] in DIGITS):
        s -= 1
    e, n, dots = s, len(t), 0
    while e < n:
        if t[e] in DIGITS:
            e += 1
        elif t[e] == "." and dots < 3 and e + 1 < n and t[e + 1] in DIGITS:
            dots += 1
            e += 1
        else:
            break
    if dots < 3:
        return None
    return s, e, all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in t[s:e].split("."))


def _card(t, a, b, after):
    s = a
    while s > after and (t[s - 1] in DIGITS or t[s - 1] in " -" and s - 1 > after and t[s - 2] in DIGITS):
        s -= 1
    e, n = b, len(t)
    while e < n and (t[e] in DIGITS or t[e] in " -" and e + 1 < n and t[e + 1] in DIGITS):
        e += 1
    number = t[s:e].replace(" ", "").replace("-", "")
    return s, e, 12 <= len(number) <= 19 and luhn(number)


def _phone(t, a, b, after):
    e, n, last = b, len(t), 0
    while e < n and t[e] in PHONE:
        if t[e] in DIGITS and e > b:
            last = e + 1
        e += 1
    if not last:
        return None
    return a, last, 9 <= sum(map(t[a:last].count, digits)) <= 15


def _iban(t, a, b, after):
    m = re.compile(r"[\s:#.=]{1,4}(?:no[.:]? ?)?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.I | re.A).match(t, b)
    if not m:
        return None
    return m.start(1), m.end(1), iban_valid(m[1].replace(" ", "").upper())


def _ssn(t, a, b, after):
    m = re.compile(r"[\s:#.=A-Za-z]{1,12}?([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])").match(t, b)
    if not m:
        return None
    return m.start(1), m.end(3), m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"


_NUMBER = re.compile(r"(?: ?(?:no|number))?[.:#= ]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_ROUTING = re.compile(r"[.:#= ]{1,4}([0-9]{9})(?![0-9])")
_SECRET = re.compile(r"[\"']? {0,2}[:=]>? {0,2}(?:\"([^\s\"']{8,200})\"|'([^\s\"']{8,200})'|([A-Za-z0-9_+/=.~-]{12,200})(?![A-Za-z0-9_+/=.~-]))")


def _number(t, a, b, after):
    m = _NUMBER.match(t, b)
    return m and (m.start(1), m.end(1), True)


def _routing(t, a, b, after):
    m = _ROUTING.match(t, b)
    return m and (m.start(1), m.end(1), sum(int(c) * w for c, w in zip(m[1], (3, 7, 1) * 3)) % 10 == 0)


def _secret(t, a, b, after):
    m = _SECRET.match(t, b)
    if not m:
        return None
    k = next(k for k in (1, 2, 3) if m[k])
    return m.start(k), m.end(k), k < 3 or not DIGITS.isdisjoint(m[3]) and not LETTERS.isdisjoint(m[3])


def _url(t, a, b, after):
    """Looks as far as the next slash, which the next scheme has, and farther only once a span is certain."""
    e, n, at = b, len(t), -1
    while e < n and not t[e].isspace() and t[e] not in "<>\"'/?#":
        if t[e] == "@" and at < 0:
            at = e
        e += 1
    if at < 0 or ":" not in t[b:at].strip(":") or at + 1 == e or t[at + 1] not in HOST:
        return None
    while e < n and not t[e].isspace() and t[e] not in "<>\"'":
        e += 1
    return a, e, True


def _address(t, a, b, after):
    s = a - (a > after and t[a - 1] == " ")
    first = s
    while first > after and t[first - 1] in LOCAL:
        first -= 1
    m = re.compile(r" ?([A-Za-z0-9-]+)(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]+)+", re.I | re.A).match(t, b)
    if first == s or not m:
        return None
    return first, m.end(), True


_PARSERS = {"email": ("email", _email), "ip": ("ip", _ip), "card": ("card", _card), "phone": ("phone", _phone),
            "iban": ("account", _iban), "ssn": ("account", _ssn), "number": ("account", _number), "routing": ("account", _routing), "secret": ("secret", _secret), "url": ("url", _url), "address": ("address", _address)}


def small(text):
    """A-Z in small letters, every letter in its place. ``lower`` is faster than a table and keeps nearly every text's length."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_SMALL)


def find(text):
    """(kind, start, end) of every valid span, by start, then kind in the order of ``KINDS``."""
    upto = dict.fromkeys(KINDS, 0)
    out = []
    for last, (name, size) in _AUTOMATON.iter(small(text)):
        kind, parse = _PARSERS[name]
        a = last + 1 - size
        if a < upto[kind]:  # within the last match of its kind
            continue
        got = parse(text, a, last + 1, upto[kind])
        if got:
            start, end, valid = got
            upto[kind] = end
            if valid:
                out.append((kind, start, end))
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs, doc_id="doc_id", text="text"):
    """Spans of each row as kind:start:end, with counts of the base kinds and their SHA-256."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [f"n_{k}" for k in BASE]

    def one(batch):
        rows = []
        for t in texts(batch.column(1)):
            spans = find(t)
            base = [s for s in spans if s[0] in BASE]
            rows.append((*[sum(s[0] == k for s in base) for k in BASE], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4]), pa.array(cols[5])],
                                          ["doc_id", *names, "base_sha256", "spans"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(
        per_batch(one), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_sha256 string, spans string")


def masked(text):
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first goes in whole."""
    out, at = [], 0
    for kind, start, end in find(text):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs, text="text", n_chars="n_chars"):
    """``docs`` with spans masked in ``text``; ``n_chars``, if there, is the new length. Null texts stay null."""
    i = docs.columns.index(text)
    j = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def one(batch):
        new = [None if t is None else masked(t) for t in batch.column(i).to_pylist()]
        cols = list(batch.columns)
        cols[i] = pa.array(new, cols[i].type)
        if j is not None:
            cols[j] = pa.array([None if t is None else len(t) for t in new], cols[j].type)
        return pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return docs.mapInArrow(per_batch(one), docs.schema)
