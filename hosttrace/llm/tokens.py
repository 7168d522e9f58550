"""Token ids of whole texts by a public tokenizer file, word by word.

The tokenizer (BPE with word ends) drops white space before it splits, so ids of a text are the ids of its
blank-separated words in a row. A worker remembers the ids of words it has seen in a hash table of fixed size, found
by numpy for a whole batch of texts at once; words are told apart by two 64-bit polynomial hashes. A full table is
emptied, which changes time, never ids.
"""

import json
import re
import zlib
from itertools import chain

import numpy as np

from hosttrace.llm.common import utf8, worker_tool

END_ID = 1
TABLE_BITS = 21
PART_BYTES = 1 << 20
_MARKS = r"""([!-/:-@\[-`{-~]*)"""
_LETTERS = re.compile(b"([a-z]+)" + _MARKS.encode())
_OTHER_LETTERS = re.compile("([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)" + _MARKS)
_SPECIAL = b"<|"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so they have inverses modulo 2^64


def tokenizer_path():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters():
    """The printable character that byte-level tokenizers write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


class _Powers:
    """Hashes of slices of a byte array: sum of (byte + 1) * base^place, place counted from the slice's start."""

    def __init__(self, base):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, values, starts, ends):
        n = len(values)
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up = self._table(self.base, size)
            self.down = self._table(pow(self.base, -1, 1 << 64), size)
        upto = np.empty(n + 1, np.uint64)
        upto[0] = 0
        np.cumsum(values * self.up[:n], out=upto[1:])
        return (upto[ends] - upto[starts]) * self.down[starts]

    @staticmethod
    def _table(base, size):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


class WordTable:
    """A hash table from blank-separated words to lists of small numbers, looked up for whole batches by numpy.

    A subclass says in ``word`` which numbers a word has. The table is emptied when it holds ``most`` words.
    """

    kind = np.uint16
    most = 1 << (TABLE_BITS - 1)

    def __init__(self):
        self.hashes = [_Powers(b) for b in _BASES]
        self.forget()

    def forget(self):
        size = 1 << TABLE_BITS
        self.key, self.check, self.place = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.pool, self.used = np.zeros(1 << 20, self.kind), 0
        self.first, self.size, self.words = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), 0

    def _keep(self, lists):
        """Adds the numbers of new words; returns their places."""
        k, n = self.words, len(lists)
        while k + n > len(self.first):
            self.first, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.size))
        sizes = np.fromiter(map(len, lists), np.int64, n)
        total = int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + total] = np.fromiter(chain.from_iterable(lists), self.kind, total)
        self.first[k:k + n], self.size[k:k + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += total
        self.words += n
        return np.arange(k, k + n, dtype=np.int32)

    def _find(self, h, g):
        """Places of words by their two hashes, -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        slot = ((h * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            s = slot[todo]
            place = self.place[s]
            hit = (self.key[s] == h[todo]) & (self.check[s] == g[todo]) & (place >= 0)
            out[todo[hit]] = place[hit]
            todo = todo[(place >= 0) & ~hit]
            slot[todo] = (slot[todo] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def _learn(self, h, g, words):
        mask = (1 << TABLE_BITS) - 1
        places = self._keep(list(map(self.word, words)))
        slot = ((h * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):  # of several words that want one free slot the last gets it, the others go on
            free = todo[self.place[slot[todo]] < 0]
            self.place[slot[free]] = places[free]
            won = free[self.place[slot[free]] == places[free]]
            self.key[slot[won]], self.check[slot[won]] = h[won], g[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & mask

    def places(self, data, raw, starts, stops):
        """Places of the words ``data[start:stop]``; unknown ones are learned."""
        values = raw.astype(np.uint64) + np.uint64(1)
        h, g = (p.of(values, starts, stops) for p in self.hashes)
        at = self._find(h, g)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if self.words > self.most:  # a batch of PART_BYTES adds fewer words than the table has room for
                self.forget()
                at = self._find(h, g)
                missing = np.flatnonzero(at < 0)
            _, one = np.unique(h[missing] ^ (g[missing] * _MIX), return_index=True)
            one = missing[np.sort(one)]
            self._learn(h[one], g[one], [data[a:b] for a, b in zip(starts[one].tolist(), stops[one].tolist())])
            at[missing] = self._find(h[missing], g[missing])
            if (at < 0).any():
                raise RuntimeError("two words of a batch share a hash")
        return at

    def numbers(self, at):
        """(numbers of the words in a row, where each word's end)."""
        sizes = self.size[at]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        return self.pool[np.repeat(self.first[at] - upto + sizes, sizes) + np.arange(total)], upto


def word_bounds(raw):
    """Starts and ends of the words of a byte array that ends in a blank."""
    blank = _SPACE[raw]
    return (np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])),
            np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]])))


class WordEncoder(WordTable):
    """Encodes batches of texts; ids are unsigned 16-bit (the vocabulary has under 65,536 entries)."""

    def __init__(self, path):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0,
                         end_of_word_suffix=model["end_of_word_suffix"])
        self.letters = byte_letters()
        self.vocabulary = self.tokenizer.get_vocab_size()
        if self.vocabulary > 1 << 16:
            raise ValueError("ids of this tokenizer need more than 16 bits")
        super().__init__()

    def forget(self):
        super().forget()
        self._keep([[END_ID], self._piece("."), self._piece(",")])  # places 0, 1 and 2

    def _piece(self, text):
        return [t.id for t in self.model.tokenize(text)]

    def word(self, word):
        """Ids of one word. Letters and the marks after them are pieces of the tokenizer, so its model can be asked."""
        m = _LETTERS.fullmatch(word)
        if m:
            return self._piece(m[1].decode()) + (self._piece(m[2].decode()) if m[2] else [])
        text = word.decode("utf-8", "replace")
        m = _OTHER_LETTERS.fullmatch(text)
        if m and "\u0130" not in text:
            return (self._piece("".join(map(self.letters.__getitem__, m[1].lower().encode())))
                    + (self._piece(m[2]) if m[2] else []))
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts):
        """Ids of all texts in a row, each with the end id, and each text's number of ids."""
        if not texts:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        # Case is folded by the tokenizer itself, except in the spelling of its special tokens.
        texts = [t if _SPECIAL in t else t.lower() for t in texts]
        data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        starts, ends = word_bounds(raw)
        # A full stop or comma after a letter is a piece of its own; without it fewer words differ.
        last, before = raw[ends - 1], raw[np.maximum(ends - 2, 0)]
        point = ((last == 46) | (last == 44)) & (ends - starts > 1) & (before >= 97) & (before <= 122)
        at = self.places(data, raw, starts, ends - point)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        n_words = np.searchsorted(starts, text_ends)
        marks = np.flatnonzero(point)
        # After a word its full stop or comma, after a text the end id.
        where = np.concatenate([marks + 1, n_words])
        what = np.concatenate([np.where(last[marks] == 46, 1, 2), np.zeros(len(texts), np.int64)])
        order = np.argsort(where, kind="stable")
        at = np.insert(at, where[order], what[order])
        pieces = np.cumsum(np.bincount(np.searchsorted(text_ends, starts[marks], side="right"), minlength=len(texts)))
        ids, upto = self.numbers(at)
        return ids, np.diff(upto[n_words + pieces + np.arange(len(texts))], prepend=0)


def encoder(path):
    """The encoder of this Python worker."""
    return worker_tool(("encoder", path), lambda: WordEncoder(path))


def parts(column):
    """The texts of a column as lists of about ``PART_BYTES``, with the row each begins at."""
    part, at, size = [], 0, 0
    for i, t in enumerate(utf8(column)):
        part.append(t)
        size += len(t)
        if size >= PART_BYTES:
            yield at, part
            part, at, size = [], i + 1, 0
    if part:
        yield at, part


def crc32(ids):
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
