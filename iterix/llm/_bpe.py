"""Byte-pair encoding through bounded caches of words and pre-tokens.

A text is cut into units at white space, where the tokenizer's own rule cuts as well: at
any for the word level, which drops it; for the byte level at the spaces, which start a
pre-token (texts with white space on both sides of a space, or before one at their end, are
cut only at spaces between other characters). Units are looked up in a cache, one pass
over the text; new ones are cut into pre-tokens, of which the new ones are merged together
in numpy, by the merge list of the tokenizer's file; the ids of a run of texts are then
gathered with whole-run arithmetic.

The rule for pre-tokens is proven for Latin-1. Units with other characters, very long
pre-tokens, and texts with special strings go to the library.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters and digits of Latin-1; with ASCII, the range in which Python's and the library's character classes agree.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_DIGIT = "0-9²³¹¼-¾"
_SPACE = r" \t\n\r\f\v"
_KNOWN = re.compile(r"[\t-\r -~¡-ÿ]*")
#: White space of Unicode, and the four ASCII separators that some tables count as such.
_ANY_SPACE = "\t-\r\x1c- \x85\xa0  -     　"
_KEPT_KEYS, _KEPT_CHARS = 400_000, 16_000_000
_LONGEST = 64

BYTE_LEVEL = re.compile(f" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
WORD_LEVEL = re.compile(f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
#: For the byte level, what makes a cut at each space unsafe, and the spaces that are safe then.
_BESIDE = re.compile(f"[{_ANY_SPACE}] (?:[{_ANY_SPACE}]|\\Z)")
_SAFE = re.compile(f"(?<=[^{_ANY_SPACE}])(?= [^{_ANY_SPACE}])")
_WORD_CUT = re.compile(f"[{_SPACE}]+")
#: A stop before a space that other marks may be part of; where there is none, stops are units of their own, marked at the byte level as without a space before.
_JOINED = re.compile(f"[,.] (?<=[^{_LETTER}{_DIGIT}][,.] )")
_BARE = "\x01"

_U = np.uint64


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[k] .. start[k] + length[k] - 1, for each k in turn."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def runs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first place, slice) of runs of about limit bytes of a string column, where nulls have none; one longer text comes alone."""
    size = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
    ends, i = np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        yield i, column.slice(i, j - i)
        i = j


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Merger:
    """Byte-pair merges of many words at once: in each round every word makes its first merge of the lowest rank."""

    def __init__(self, model: dict):
        vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        self.letter = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        rank, at = np.arange(len(pairs)), self._slot(keys)
        while len(keys):  # open addressing: of those that want a free slot, the first gets it
            free = np.flatnonzero(self.keys[at] < 0)
            won = np.zeros(len(keys), bool)
            won[free[np.unique(at[free], return_index=True)[1]]] = True
            self.keys[at[won]], self.ranks[at[won]] = keys[won], rank[won]
            keys, rank, at = keys[~won], rank[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], self.none)
        left = np.flatnonzero((held != key) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[left]]
            hit = held == key[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each has); none is empty."""
        coded = [w.encode() for w in words]
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        raw = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(length)
        sym = self.letter[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        done_word, done_sym, done_n = [], [], []
        word, start = np.arange(len(words)), ends - length
        rank = np.full(len(sym), self.none, np.int64)
        inner = np.ones(len(sym), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.rank(sym[at], sym[at + 1])
        while len(word):
            low = np.minimum.reduceat(rank, start)
            live = low < self.none
            if not live.all():
                over = np.repeat(~live, length)
                done_word.append(word[~live])
                done_n.append(length[~live])
                done_sym.append(sym[over])
                sym, rank = sym[~over], rank[~over]
                word, low, length = word[live], low[live], length[live]
                start = np.cumsum(length) - length
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            of = np.searchsorted(start, hit, "right") - 1
            first = np.ones(len(hit), bool)
            first[1:] = of[1:] != of[:-1]
            at = hit[first]  # one of each word
            sym[at] = self.result[low]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            rank[at] = np.where(length + start == at + 2, self.none, -1)  # the merged pair's right neighbour is a word's end, or not
            sym, rank = sym[stay], rank[stay]
            length = length - 1
            start = np.cumsum(length) - length
            at = at - np.arange(len(at))  # one symbol fewer in each word before
            right = at[rank[at] < 0]
            rank[right] = self.rank(sym[right], sym[right + 1])
            left = at[at > start] - 1
            rank[left] = self.rank(sym[left], sym[left + 1])
        of, size = np.concatenate(done_word), np.concatenate(done_n)
        begin, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[of], n[of] = np.cumsum(size) - size, size
        return np.concatenate(done_sym).astype(np.uint32)[spans(begin, n)], n


class Numbers(dict):
    """Numbers keys as they come; new: those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at


class Table:
    """Ids of keys. Those not met before are made together; when there are too many, the half used last stays, without long keys."""

    def __init__(self, make):
        self.make, self.turn = make, 0
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.chars = Numbers(), 0
        self.start, self.length, self.last = (np.zeros(1024, np.int64) for _ in range(3))
        self.arena, self.used = np.zeros(4096, np.uint32), 0

    def _put(self, keys: list, ids: np.ndarray, n: np.ndarray) -> None:
        to = len(self.numbers)
        first = to - len(keys)
        if to > len(self.start):
            for name in ("start", "length", "last"):
                setattr(self, name, np.concatenate([getattr(self, name)[:first], np.zeros(2 * to - first, np.int64)]))
        self.start[first:to], self.length[first:to] = self.used + np.cumsum(n) - n, n
        if self.used + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.arena[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.chars += sum(len(k) if type(k) is str else len(k[0]) for k in keys)

    def _shrink(self) -> None:
        keys, last = list(self.numbers), self.last[: len(self.numbers)]
        stay = last > np.median(last)
        stay &= np.fromiter((len(k) <= _LONGEST and type(k) is str for k in keys), bool, len(keys))
        at = np.flatnonzero(stay)
        n = self.length[at]
        ids, turns = (self.arena[spans(self.start[at], n)] if self.used else np.zeros(0, np.uint32)), last[at]
        self._empty()
        kept = [keys[k] for k in at.tolist()]
        self.numbers.update(zip(kept, range(len(kept))))
        self._put(kept, ids, n)
        self.last[: len(kept)] = turns

    def slots(self, keys: list) -> np.ndarray:
        """The places of keys in start and length."""
        if len(self.numbers) > _KEPT_KEYS or self.chars > _KEPT_CHARS:
            self._shrink()
        at = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        if self.numbers.new:
            new, self.numbers.new = self.numbers.new, []
            self._put(new, *self.make(new))
        self.turn += 1
        self.last[at] = self.turn
        return at

    def ids(self, slots: np.ndarray) -> np.ndarray:
        return self.arena[spans(self.start[slots], self.length[slots])]


class Encoder:
    """Ids of texts by the library's file at path. kind: 'byte' or 'word'."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = kind == "word"
        self.find = (WORD_LEVEL if self.lower else BYTE_LEVEL).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.probe = os.path.commonprefix(self.special)  # in each of them
        self.merger = Merger(json.loads(self.tokenizer.to_str())["model"])
        self.table, self.parts = Table(self._units_ids), Table(self.merged)

    def _has_special(self, text: str) -> bool:
        return self.probe in text and any(s in text for s in self.special)

    def units(self, text: str) -> list:
        """The units of a text. A string is Latin-1, in lower case at the word level, and stands for itself after a space at the byte level; a tuple holds just what it stands for."""
        if self._has_special(text):
            return [(text,)]
        if not _KNOWN.fullmatch(text):
            if self.lower:
                return [(u,) for u in _WORD_CUT.split(text)]
            return [u[1:] if u[:1] == " " and _KNOWN.fullmatch(u) else (u,) for u in _SAFE.split(text)]
        if self.lower:
            text = text.lower()
            if not _JOINED.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
            return text.split()
        if _BESIDE.search(text):
            return [u[1:] if u[:1] == " " else (u,) for u in _SAFE.split(text)]
        if not _JOINED.search(text):
            text = text.replace(", ", f" {_BARE}, ").replace(". ", f" {_BARE}. ")
        out: list = text.split(" ")
        out[0] = (out[0],)
        return out

    def pre_tokens(self, unit) -> list:
        """The pre-tokens of a unit; in a tuple, what the library is to cut."""
        if type(unit) is tuple:
            text = unit[0]
            if self._has_special(text) or not _KNOWN.fullmatch(text):
                return [unit]
            return self.find(text.lower() if self.lower else text)
        if unit.isalpha():
            return [unit if self.lower else " " + unit]
        if unit[:1] == _BARE:
            return [unit[1:]]
        return self.find(unit if self.lower else " " + unit)

    def merged(self, tokens: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pre-tokens in turn, how many each has)."""
        ours = np.array([type(t) is str and len(t) <= _LONGEST for t in tokens])
        quick, slow = np.flatnonzero(ours), np.flatnonzero(~ours)
        parts, sizes = [np.zeros(0, np.uint32)], np.zeros(len(tokens), np.int64)
        if len(quick):
            ids, sizes[quick] = self.merger.merge([tokens[k] for k in quick.tolist()] if len(slow) else tokens)
            parts.append(ids)
        if len(slow):
            texts = [t if type(t) is str else t[0] for t in (tokens[k] for k in slow.tolist())]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes[slow] = [len(x) for x in found]
            parts += [np.array(x, np.uint32) for x in found]
        order = np.concatenate([quick, slow])
        begin = np.zeros(len(tokens), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(parts)[spans(begin, sizes)], sizes

    def _units_ids(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.pre_tokens(u) for u in units]
        alone = np.fromiter((len(c) == 1 and type(c[0]) is str for c in cut), bool, len(cut))
        one, rest = np.flatnonzero(alone), np.flatnonzero(~alone)
        n = np.zeros(len(cut), np.int64)
        ids, n[one] = self.merged([cut[k][0] for k in one.tolist()])  # a table of these would hold what that of units holds
        cut = [cut[k] for k in rest.tolist()]
        slots = self.parts.slots([t for c in cut for t in c])
        ends = np.concatenate([[0], np.cumsum(self.parts.length[slots])])
        last = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        n[rest] = np.diff(ends[last])
        order = np.concatenate([one, rest])
        begin = np.zeros(len(n), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate([ids, self.parts.ids(slots)])[spans(begin, n)], n

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each followed by end_id, how many each has) of a string column without nulls."""
        units: list = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts.to_pylist()):
            at = len(units)
            units += self.units(text)
            counts[k] = len(units) - at
        slots = self.table.slots(units)
        ends = np.concatenate([[0], np.cumsum(self.table.length[slots])])
        n = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        out = np.full(len(n) + int(n.sum()), end_id, np.uint32)
        rest = np.ones(len(out), bool)
        rest[np.cumsum(n + 1) - 1] = False
        out[rest] = self.table.ids(slots)
        return out, n + 1


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, kind: str) -> Encoder:
    """The encoder of a vocabulary file, one for each worker process. name: a path, or a file of the installed vocabularies."""
    if (name, kind) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        if "/" in name:
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[name, kind] = Encoder(path, kind)
    return _encoders[name, kind]


def release() -> None:
    """Drops this process's encoders: a worker that goes on to a step without them has no use for their caches."""
    if _encoders:
        _encoders.clear()
        gc.collect()  # tables and their encoder refer to each other
