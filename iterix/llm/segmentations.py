"""SentencePiece segmentations sampled without replacement, and decoding.

The lattice of a text has a node at each character and an edge for each vocabulary
piece. A piece weighs exp(-alpha * ln(1 + merge rank)): the vocabulary's scores are
merge ranks, and by Zipf's law the logarithm of a rank is the negative log frequency
up to a constant. Summed from the end, the weights turn into exact probabilities of
each edge at its node, so a segmentation has its exact probability under the lattice.

Gumbel top-k by A-star search (Maddison et al. 2014; Kool et al. 2019): the queue holds
sets of segmentations that share a prefix and avoid some edges at its end. Each has the
greatest perturbed log probability in it, drawn from its exact mass, truncated at its
parent's. Taking the best set gives the next sample and splits the rest of the set in
disjoint sets, one for each edge of the sample; these wait as one, and are told apart
when their best is taken. The k samples are distinct; with kappa,
the best value left in the queue, a sample's inclusion score is the probability
1 - exp(-exp(log_prob - kappa)) that it is among the k.

No piece spans a word's start, so the lattice is a chain of word lattices: those of
frequent words are kept, and the words of all texts of a batch are walked together in
numpy. All randomness is a hash of (seed, row key, place), so a row
gets the same samples wherever it is computed.

Whole texts are used. Memory follows `batch_chars`, or the longest text if that is more, and
`kept_edges`.
Defined cases: null and empty texts have one segmentation, of no pieces, with
probability and inclusion 1; a text with fewer than k segmentations gives them all,
with inclusion 1; characters without a piece are their UTF-8 byte pieces; rows that
repeat a doc_id and text get equal samples; a null doc_id is a key of its own; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iterix.llm._bpe import spans as _spans
from iterix.llm._text import mix
from iterix.session import ship

SPACE = "▁"
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Of a multiplicative congruential generator modulo 2^64 (Steele and Vigna 2021); its keys are odd, its high bits are used.
_MULTIPLIER = _U(0xD1342543DE82EF95)
_SCHEMA = "doc_id long, sample int, {} log_prob double, inclusion double"


@dataclass(frozen=True)
class SegmentationConfig:
    samples: int = 4
    alpha: float = 0.5
    seed: int = 17
    unknown_rank: int = 10_000_000
    batch_chars: int = 1 << 19
    kept_edges: int = 10_000_000


def normalise(text: str | None) -> str:
    """What the pieces of a text spell: a space before it, and every space as the space mark."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _unit(key: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from hashes."""
    u = (mix(key) >> _U(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def _gumbel(key: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_unit(key)))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number; zeros follow the last."""
    return np.ndarray(len(raw) + 1, "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,)).copy()


class Vocabulary:
    """The pieces of a model file as a trie in arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id, self.is_byte = np.full(256, -1, np.int64), np.zeros(n + 1, bool)  # the last place: no piece
        self.surface: list[bytes] = [b""] * n
        pieces: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)], self.is_byte[i] = i, True
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[piece] = i
                self.surface[i] = piece.encode()
        self.bytes_of = np.array([len(x) for x in self.surface], np.int32)
        self.eight = np.array([int.from_bytes(x[:8], "little") for x in self.surface], np.uint64)
        self.eight_mask = np.array([(1 << 8 * min(8, len(x))) - 1 for x in self.surface], np.uint64)
        ranked = sorted(pieces, key=lambda p: (-sp.get_score(pieces[p]), pieces[p]))
        self.rank = np.zeros(n)
        for r, p in enumerate(ranked):
            self.rank[pieces[p]] = r
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans the start of a word")
        parts = {c for p in pieces if len(p) > 1 for c in p}
        joined = "".join(sorted(parts - {SPACE}))
        inner = f"[{re.escape(joined)}]" if joined else r"[^\s\S]"
        # characters of no longer piece stand alone
        self.words = re.compile(f"{SPACE}+{inner}*|{inner}+|[\\s\\S]")
        letters = sorted(parts) + sorted({c for p in pieces for c in p} - parts)
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.width = len(letters)
        children: dict[int, int] = {}
        final = [-1]
        for p in pieces:
            node = 0
            for c in p:
                key = node * (self.width + 1) + int(self.letter[ord(c)])
                node = children.get(key, 0)
                if not node:
                    node = children[key] = len(final)
                    final.append(-1)
            final[node] = pieces[p]
        self.final = np.array(final)
        self.bits = max(8, (4 * len(children)).bit_length())
        self.slots = np.zeros(1 << self.bits, np.dtype([("key", np.int64), ("node", np.int64)]))
        self.slots["key"] = -1
        keys, nodes = np.array(list(children), np.int64), np.array(list(children.values()), np.int64)
        at = self._slot(keys)
        while len(keys):  # open addressing: of those that want a free slot, the first gets it
            free = self.slots["key"][at] < 0
            won = np.zeros(len(keys), bool)
            first = np.unique(at[free], return_index=True)[1]
            won[np.flatnonzero(free)[first]] = True
            self.slots["key"][at[won]], self.slots["node"][at[won]] = keys[won], nodes[won]
            keys, nodes, at = keys[~won], nodes[~won], (at[~won] + 1) & ((1 << self.bits) - 1)
        self.root = self.child(np.zeros(self.width + 1, np.int64), np.arange(self.width + 1))
        #: The nodes of all pairs of the letters of longer pieces, where the table stays small; the last row and column: of others, or no letter.
        self.parts = len(parts)
        row, column = np.divmod(np.arange((self.parts + 1) ** 2), self.parts + 1)
        self.second = self.child(self.root[row], column) if self.parts <= 1024 else None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _STEP) >> _U(64 - self.bits)).astype(np.int64)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node below, or 0. No letter is -1, or the width: no key has either."""
        key = node * (self.width + 1) + letter
        at = self._slot(key)
        slot = self.slots.take(at)
        same = slot["key"] == key
        out = np.where(same, slot["node"], 0)
        left = np.flatnonzero((slot["key"] >= 0) & ~same)
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            slot = self.slots.take(at[left])
            same = slot["key"] == key[left]
            out[left[same]] = slot["node"][same]
            left = left[(slot["key"] >= 0) & ~same]
        return out

    def below(self, level: int, node: np.ndarray, letter: np.ndarray, before: np.ndarray) -> np.ndarray:
        """As child, for nodes at a level of the trie (from 0), with the letters that lead to them."""
        if level == 0:
            return self.root.take(letter, mode="wrap")
        if level > 1 or self.second is None:
            return self.child(node, letter)
        return self.second.take(np.minimum(before, self.parts) * (self.parts + 1) + np.minimum(letter, self.parts), mode="wrap")

    def targets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The joined bytes that the pieces of each text spell, their number, and the eight bytes from each place on."""
        whole = [normalise(t).encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"".join(whole), np.uint8)
        return raw, np.array([len(w) for w in whole], np.int64), _eights(raw)

    def spells(self, ids: np.ndarray, n: np.ndarray, target: tuple[np.ndarray, np.ndarray, np.ndarray], text: np.ndarray) -> np.ndarray:
        """Whether the n ids of each of the texts decode to it; target: of all texts."""
        raw, size, eights = target
        if len(text) < len(size):
            raw, size = raw[_spans((np.cumsum(size) - size)[text], size[text])], size[text]
            eights = _eights(raw)
        width = self.bytes_of[ids]
        ends = np.concatenate([[0], np.cumsum(width)])
        head = np.cumsum(n) - n
        out = ends[head + n] - ends[head] == size
        if out.all() and len(ids):
            same = ((eights[ends[:-1]] ^ self.eight[ids]) & self.eight_mask[ids]) == 0
            for k in np.flatnonzero(width > 8).tolist():
                same[k] = self.surface[ids[k]] == raw[ends[k] : ends[k + 1]].tobytes()
            full = np.flatnonzero(n)
            out[full] = np.logical_and.reduceat(same, head[full])
        elif len(ids):  # lengths differ somewhere: text by text
            at = np.concatenate([[0], np.cumsum(size)])
            out = np.array([b"".join(self.surface[i] for i in ids[h : h + m]) == raw[i:j].tobytes() for h, m, i, j in zip(head, n, at, at[1:])], bool)
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        text = b"".join(self.surface[i] for i in ids).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


class Lattice:
    """The lattices of many words: edges in node order, with their conditional log probabilities. Words can be added, and the last ones taken off."""

    #: Of a node: its first edge (-1 at its word's end), its number of edges, its character.
    NODES = {"begin": np.int32, "degree": np.int32, "point": np.int32}
    #: What a walk reads of an edge, in one place: the greatest key that takes it or one before it at its node, and the first edge after it (-1 at its word's end).
    STEP = np.dtype([("bound", np.uint64), ("next", np.int64)])
    #: Of an edge: its node, its piece (-1: the byte pieces of its character), its log probability at its node, the sum of probabilities of all others there.
    EDGES = {"start": np.int32, "piece": np.int32, "step": STEP, "logp": np.float64, "rest": np.float64}

    def __init__(self, vocabulary: Vocabulary, cfg: SegmentationConfig):
        self.vocabulary = vocabulary
        rank = np.append(vocabulary.rank, cfg.unknown_rank)
        rank[vocabulary.is_byte] = cfg.unknown_rank
        self.weights = -cfg.alpha * np.log1p(rank)
        self.size = (0, 0, 0)  # words, nodes, edges
        self.first = np.zeros(1024, np.int32)  # of each word: its first edge
        for name, kind in (self.NODES | self.EDGES).items():
            setattr(self, name, np.zeros(8192, kind))

    def add(self, words: list[str]) -> None:
        if not words:
            return
        n_words, n_nodes, n_edges = self.size
        new = self._of(words)
        first, nodes, edges = new.pop("first"), len(new["begin"]), len(new["start"])
        self.size = (n_words + len(first), n_nodes + nodes, n_edges + edges)
        self._put("first", n_words, first + n_edges)
        new["begin"][new["begin"] >= 0] += n_edges
        new["start"] += n_nodes
        after = new["step"]["next"]
        after[after >= 0] += n_edges
        for name in self.NODES:
            self._put(name, n_nodes, new[name])
        for name in self.EDGES:
            self._put(name, n_edges, new[name])

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            grown = np.zeros(max(2 * len(held), at + len(values)), held.dtype)
            grown[:at] = held[:at]
            setattr(self, name, held := grown)
        held[at : at + len(values)] = values

    def _of(self, words: list[str]) -> dict[str, np.ndarray]:
        vocabulary = self.vocabulary
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths + 1) - (lengths + 1)  # of each word's nodes; one more ends it
        n_nodes = int((lengths + 1).sum())
        letter, point, inside = np.full(n_nodes, -1, np.int64), np.zeros(n_nodes, np.int32), np.ones(n_nodes, bool)
        inside[first + lengths] = False
        at = np.flatnonzero(inside)
        letter[at], point[at] = vocabulary.letter.take(points), points
        found = []
        live, node, reach, before = at, np.zeros(len(at), np.int64), at, np.zeros(len(at), np.int64)
        degree = np.zeros(n_nodes, np.int64)
        for level in itertools.count():
            if not len(live):
                break
            now = letter.take(reach)
            node = vocabulary.below(level, node, now, before)
            on = np.flatnonzero(node)
            if len(on) < len(node):
                live, node, reach, now = live.take(on), node.take(on), reach.take(on), now.take(on)
            reach, before = reach + 1, now
            of = vocabulary.final.take(node)
            hit = np.flatnonzero(of >= 0)
            starts = live.take(hit)
            if not level:  # one letter; a character without a piece still has an edge
                lone = inside.copy()
                lone[starts] = False
                lone = np.flatnonzero(lone)
                alone = np.where(point[lone] < 128, vocabulary.byte_id[point[lone] & 127], -1)  # of one byte, or of several
                found.append((lone, lone + 1, alone, 0))
                degree[at] = 1
                found.append((starts, reach.take(hit), of.take(hit), 0))
            else:
                nth = degree.take(starts)
                found.append((starts, reach.take(hit), of.take(hit), nth))
                degree[starts] = nth + 1
        begin = np.cumsum(degree) - degree
        n_edges = int(degree.sum())
        start, stop, piece = np.repeat(np.arange(n_nodes), degree), np.zeros(n_edges, np.int64), np.zeros(n_edges, np.int64)
        last = begin + degree - 1
        for starts, stops, pieces, nth in found:  # a node's longest edge, often the likeliest, comes first
            to = last.take(starts) - nth
            stop[to], piece[to] = stops, pieces
        weight = self.weights.take(piece, mode="wrap")
        # mass from each node to its word's end, nearest nodes first
        mass = np.zeros(n_nodes)
        longest = int(lengths.max(initial=0))
        distance = np.repeat(first + lengths, lengths + 1) - np.arange(n_nodes)
        if longest < 1 << 15:
            distance = distance.astype(np.int16)  # sorted by digits
        by = np.argsort(distance, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(distance, minlength=longest + 1))])[1:]
        n = degree.take(by)
        order = _spans(begin.take(by), n)
        weights, stops, head = weight.take(order), stop.take(order), np.append(np.cumsum(n) - n, n_edges)
        for lo, hi in zip(cut[:-1], cut[1:]):
            i, j = head[lo], head[hi]
            value = weights[i:j] + mass.take(stops[i:j])
            heads = head[lo:hi] - i
            top = np.maximum.reduceat(value, heads)
            mass[by[lo:hi]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n[lo:hi])), heads))
        logp = weight + mass.take(stop) - mass.take(start)
        p = np.exp(logp)
        inner = np.flatnonzero(degree)
        heads = begin[inner]
        total = np.cumsum(p)
        before = np.zeros(n_nodes)
        before[inner] = total[heads] - p[heads]
        cum = total - before.take(start)
        cum[heads + degree[inner] - 1] = 2.0  # the last edge takes the rest
        # the mass of an edge's siblings; where it is small, summed without the edge
        rest = 1 - p
        large = np.flatnonzero(p > 0.5)
        if len(large):
            small = np.zeros(n_nodes)
            p[large] = 0.0
            small[inner] = np.add.reduceat(p, heads)
            rest[large] = small[start[large]]
        first = begin[first]
        begin[degree == 0] = -1
        step = np.empty(n_edges, self.STEP)
        # u of 53 bits, the high ones of a key, takes the first edge with u < cum; keys are odd
        bound = np.ceil(np.minimum(cum, 1.0) * 2.0**53).astype(np.uint64) << _U(11)  # 0 for 1: then less 1 it is the greatest key
        step["bound"] = np.where(cum > 0, bound, _U(1)) - _U(1)
        step["next"] = begin.take(stop)
        return {"first": first, "begin": begin, "degree": degree, "point": point, "start": start, "piece": piece, "step": step, "logp": logp, "rest": rest}

    def walk(self, edge: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled edges from the node of each of the edges, its first, to its word's end (-1: there): the number of each walk's, and the edges, walk by walk."""
        taken, which = [], np.arange(len(edge))
        lengths = np.zeros(len(edge), np.int64)
        on = np.flatnonzero(edge >= 0)
        while len(on):
            if len(on) < len(edge):
                which, edge, key = which.take(on), edge.take(on), key.take(on)
            step = self.step.take(edge)
            more = np.flatnonzero(step["bound"] < key)
            if len(more):
                edge = edge.copy()
                while len(more):
                    edge[more] += 1
                    step[more] = other = self.step.take(edge[more])
                    more = more[other["bound"] < key[more]]
            taken.append((which, edge))
            edge, key = step["next"], key * _MULTIPLIER
            on = edge >= 0
            lengths[which.take(np.flatnonzero(~on))] = len(taken)
            on = np.flatnonzero(on)
        start = np.cumsum(lengths) - lengths
        edges = np.zeros(int(lengths.sum()), np.int32)
        for k, (which, edge) in enumerate(taken):  # every walk takes one step a turn
            edges[start[which] + k] = edge
        return lengths, edges


@dataclass
class Samples:
    """The samples of one rank, of those texts that have it."""

    text: np.ndarray
    edges: np.ndarray
    lengths: np.ndarray  # edges of each text
    log_prob: np.ndarray
    inclusion: np.ndarray


class Search:
    """The queues of many texts, worked in step. One round takes the best set of every text.

    A path's sets, one for each step that it could have left at, wait as one: the
    greatest value in all of them is drawn from their total mass, and the set that
    holds it in proportion to their masses. All sets that leave after a step have
    less mass together than the path up to it. So the masses of the first AHEAD
    steps are noted, and all others only where they could count: where that bound is
    not below 2^-60 of the total, which no sum in double precision can tell from none.
    """

    AHEAD = 256

    def __init__(self, lattice: Lattice, words: np.ndarray, counts: np.ndarray, keys: np.ndarray, rounds: int):
        """words: of all texts in turn, as numbers of the lattice; counts: words of each text; keys: of each text."""
        self.lat, self.words, self.counts, self.keys, self.rounds = lattice, words, counts, keys, rounds
        self.word_first = np.cumsum(counts) - counts
        n = len(counts)
        self.used = 0  # of the three below: the paths' edges, their words' places, and the masses of the sets that leave there
        self.edges, self.place, self.mass = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        ints = lambda: np.zeros((rounds, n), np.int64)
        self.at, self.size, self.own, self.branch = ints(), ints(), ints(), ints()  # where a path starts, its length, its first step of its own, where its best set leaves
        self.before = np.zeros((rounds, n))  # the log probability of the steps that are not its own
        self.top = np.zeros((rounds, n))  # what its sets are truncated at
        self.best = np.full((rounds, n), -np.inf)
        self.taken = ints()  # how many of its sets were taken
        self.noted = ints()  # up to which step the masses of its sets are noted
        self.upto = np.zeros((rounds, n))  # its log probability up to there
        self.avoid = np.full((rounds, n, rounds), -1, np.int64)  # edges that the set at the first own step avoids

    def _key(self, text: np.ndarray, turn: int | np.ndarray, use: int) -> np.ndarray:
        step = (np.asarray(turn, np.uint64) * _U(4) + _U(use + 1)) * np.full(1, _STEP)
        return mix(self.keys[text] + step)

    def _suffix(self, text: np.ndarray, turn: int, word: np.ndarray, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of steps of each text, word places, edges) from a node of a word of each text to the text's end. after: the first edge there, or -1 at the word's end; None: from the words' starts."""
        n = self.word_first[text] + self.counts[text] - word
        place = _spans(word, n)
        begin = self.lat.first[self.words[place]].astype(np.int64)
        head = np.cumsum(n) - n
        if after is not None:
            begin[head] = after
        nth = place - np.repeat(self.word_first[text], n)
        key = mix(np.repeat(self._key(text, turn, 0), n) + nth.astype(np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)
        walked, edge = self.lat.walk(begin, key)
        ends = np.concatenate([[0], np.cumsum(walked)])
        return ends[head + n] - ends[head], np.repeat(place, walked), edge

    def _store(self, edge: np.ndarray, place: np.ndarray) -> int:
        at, to = self.used, self.used + len(edge)
        if to > len(self.edges):
            room = max(to, self.rounds * len(edge) if not at else 2 * len(self.edges))
            for name in ("edges", "place", "mass"):
                held = getattr(self, name)
                grown = np.zeros(room, held.dtype)
                grown[:at] = held[:at]
                setattr(self, name, grown)
        self.edges[at:to], self.place[at:to] = edge, place
        self.used = to
        return at

    def _sum(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The log probability of n steps from at. Summed by text: a running sum's rounding would depend on the batch."""
        out, full = np.zeros(len(n)), np.flatnonzero(n > 0)
        if len(full):
            m = n[full]
            out[full] = np.add.reduceat(self.lat.logp.take(self.edges[_spans(at[full], m)]), np.cumsum(m) - m)
        return out

    def _split(self, turn: int, text: np.ndarray, rest: np.ndarray | None) -> np.ndarray:
        """Note the masses of the sets that the paths of a round split off; rest: relative, of those at the first own steps. Returns the paths' log probabilities."""
        own, size = self.own[turn, text], self.size[turn, text]
        start, before = self.at[turn, text] + own, self.before[turn, text]
        self.noted[turn, text], self.upto[turn, text] = own, before
        self._note(np.full(len(text), turn), text, np.minimum(size, own + self.AHEAD))
        if rest is not None:
            self.mass[start] = np.exp(before) * rest
        return before + self._sum(start, size - own)

    def _note(self, turn: np.ndarray, text: np.ndarray, to: np.ndarray) -> None:
        """Note the masses of the sets that leave paths up to a step."""
        full = np.flatnonzero(to > self.noted[turn, text])
        if not len(full):
            return
        turn, text, to = turn[full], text[full], to[full]
        n = to - self.noted[turn, text]
        at = _spans(self.at[turn, text] + self.noted[turn, text], n)
        edge = self.edges[at]
        logp = self.lat.logp.take(edge)
        head = np.cumsum(n) - n
        run = np.cumsum(logp)
        before = (run - logp) + np.repeat(self.upto[turn, text] - (run - logp)[head], n)
        self.mass[at] = np.exp(before) * self.lat.rest.take(edge)
        self.noted[turn, text] = to
        self.upto[turn, text] += np.add.reduceat(logp, head)  # by text: a running sum's rounding depends on the batch

    def _masses(self, turn: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(masses noted, the first of each path, how many, their sums) of paths with steps of their own."""
        n = self.noted[turn, text] - self.own[turn, text]
        mass = self.mass[_spans(self.at[turn, text] + self.own[turn, text], n)]
        head = np.cumsum(n) - n
        return mass, head, n, np.add.reduceat(mass, head)

    def _draw(self, turn: np.ndarray, text: np.ndarray) -> None:
        """Draw the best of what is left of paths' sets."""
        self.best[turn, text] = -np.inf
        full = np.flatnonzero(self.size[turn, text] > self.own[turn, text])
        turn, text = turn[full], text[full]
        if not len(text):
            return
        mass, head, n, total = self._masses(turn, text)
        size = self.size[turn, text]
        short = np.flatnonzero((self.noted[turn, text] < size) & (np.exp(self.upto[turn, text]) >= total * 2.0**-60))
        if len(short):
            self._note(turn[short], text[short], size[short])
            mass, head, n, total = self._masses(turn, text)
        ok = np.flatnonzero(total > 0)
        turn, text = turn[ok], text[ok]
        key = mix(self._key(text, turn, 1) + self.taken[turn, text].astype(np.uint64) * _U(0xD1B54A32D192ED03))
        self.best[turn, text] = -np.logaddexp(-self.top[turn, text], -(np.log(total[ok]) + _gumbel(key)))
        # the set that holds it
        run = np.cumsum(mass)
        goal = (run - mass)[head[ok]] + _unit(key + _STEP) * total[ok]
        step = np.clip(np.searchsorted(run, goal, "right") - head[ok], 0, n[ok] - 1)
        for k in np.flatnonzero(mass[head[ok] + step] == 0).tolist():  # rounding met a set without mass: take the greatest
            step[k] = int(np.argmax(mass[head[ok[k]] : head[ok[k]] + n[ok[k]]]))
        self.branch[turn, text] = step + self.own[turn, text]

    def run(self) -> list[Samples]:
        n, lat = len(self.counts), self.lat
        text = np.arange(n)
        lengths, place, edge = self._suffix(text, 0, self.word_first, None)
        self.at[0], self.size[0] = np.cumsum(lengths) - lengths + self._store(edge, place), lengths
        self.top[0] = _gumbel(self._key(text, 0, 2))
        found = [(text, self._split(0, text, None))]
        self._draw(np.zeros(n, np.int64), text)
        for turn in range(1, self.rounds):
            path = self.best[:turn].argmax(0)
            top = self.best[path, np.arange(n)]
            text = np.flatnonzero(np.isfinite(top))
            if not len(text):
                break
            path, top = path[text], top[text]
            nth = self.branch[path, text]
            from_, own = self.at[path, text], self.own[path, text]
            old, word = self.edges[from_ + nth].astype(np.int64), self.place[from_ + nth].astype(np.int64)
            avoid = np.full((len(text), self.rounds), -1, np.int64)
            avoid[:, 0] = old
            first = (path > 0) & (nth == own)
            avoid[first] = self.avoid[path[first], text[first]]
            # the edge that leaves the prefix: the greatest perturbed log probability of those not avoided
            node = lat.start[old]
            degree = lat.degree[node]
            options = _spans(lat.begin[node], degree)
            of = np.repeat(np.arange(len(text)), degree)
            barred = (options[:, None] == avoid[of]).any(1)
            noise = _gumbel(mix(self._key(text, turn, 3)[of] + (options - lat.begin[node][of]).astype(np.uint64) * _U(0xD1B54A32D192ED03)))
            score = np.where(barred, -np.inf, lat.logp[options] + noise)
            head = np.cumsum(degree) - degree
            most = np.maximum.reduceat(score, head)
            hit = np.flatnonzero((score == most[of]) & ~barred)
            new = options[hit[np.unique(of[hit], return_index=True)[1]]]
            left = np.where(barred | (options == new[of]), 0.0, np.exp(lat.logp[options]))
            rest = np.add.reduceat(left, head)
            avoid[np.arange(len(text)), np.minimum((avoid >= 0).sum(1), self.rounds - 1)] = new
            self.avoid[turn, text] = avoid
            # the set is taken off its path
            self.before[turn, text] = self.before[path, text] + self._sum(from_ + own, nth - own)
            self.mass[from_ + nth] = 0.0
            self.taken[path, text] += 1
            self.top[path, text] = top
            self._draw(path, text)
            # the prefix, the new edge, and a fresh suffix
            n_after, s_place, s_edge = self._suffix(text, turn, word, lat.step["next"][new])
            lengths = nth + 1 + n_after
            base = np.cumsum(lengths) - lengths
            edge, place = np.zeros(int(lengths.sum()), np.int32), np.zeros(int(lengths.sum()), np.int32)
            to, prefix = _spans(base, nth), _spans(from_, nth)
            edge[to], place[to] = self.edges[prefix], self.place[prefix]
            edge[base + nth], place[base + nth] = new, word
            to = _spans(base + nth + 1, n_after)
            edge[to], place[to] = s_edge, s_place
            at = base + self._store(edge, place)
            self.at[turn, text], self.size[turn, text], self.own[turn, text], self.top[turn, text] = at, lengths, nth, top
            found.append((text, self._split(turn, text, rest)))
            self._draw(np.full(len(text), turn), text)
        kappa = self.best.max(0)
        out = []
        for turn, (text, log_prob) in enumerate(found):
            size = self.size[turn, text]
            with np.errstate(over="ignore"):
                inclusion = np.round(-np.expm1(-np.exp(log_prob - kappa[text])), 9)
            out.append(Samples(text, self.edges[_spans(self.at[turn, text], size)], size, log_prob, inclusion))
        return out


def row_keys(doc_ids: pa.Array, seed: int) -> np.ndarray:
    null = np.asarray(doc_ids.is_null())
    ids = np.asarray(doc_ids.fill_null(0)).astype(np.int64).view(np.uint64)
    return mix(ids * _STEP + _U(2 * seed + 1) + null.astype(np.uint64) * _U(0xA0761D6478BD642F))


class Sampler:
    """Samples of batches of texts. Texts are cut at their spaces into units of one or more words; the lattices of units met in a second batch are kept, up to a limit, others are made for each batch."""

    def __init__(self, vocabulary: Vocabulary, cfg: SegmentationConfig):
        self.vocabulary, self.cfg = vocabulary, cfg
        self.lattice, self.units = Lattice(vocabulary, cfg), {}
        self.kept = (0, 0, 0)
        self.met = np.zeros(1 << 22, bool)  # hashes of units
        self.word_at, self.word_count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)  # of each unit: its first word in the lattice, and how many

    @staticmethod
    def _cut(text: str | None) -> list:
        """The units of a text: a string stands for what follows a space mark, a tuple for a text whose spaces do not part its words."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            return [(text,)]
        return text.split(" ")

    def _add(self, units: list, first: int) -> None:
        """Make the lattices of units, the first of them being that number."""
        if not units:
            return
        find = self.vocabulary.words.findall
        plain = [u for u in units if type(u) is str]
        words = find(SPACE + SPACE.join(plain)) if plain else []
        heads = [k for k, w in enumerate(words) if w[0] == SPACE]
        counts = np.diff(np.array([*heads, len(words)], np.int64))
        if len(plain) < len(units):
            odd = [find(normalise(u[0])) for u in units if type(u) is tuple]
            words += [w for x in odd for w in x]
            counts = np.concatenate([counts, np.array([len(x) for x in odd], np.int64)])
            tail = np.array([type(u) is tuple for u in units])
            order = np.empty(len(units), np.int64)
            order[~tail], order[tail] = np.arange(len(plain)), np.arange(len(plain), len(units))
        else:
            order = np.arange(len(units))
        to = first + len(units)
        if to > len(self.word_at):
            self.word_at, self.word_count = (np.concatenate([x[:first], np.zeros(2 * to - first, np.int64)]) for x in (self.word_at, self.word_count))
        self.word_at[first:to] = self.lattice.size[0] + (np.cumsum(counts) - counts)[order]
        self.word_count[first:to] = counts[order]
        self.lattice.add(words)

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts in turn, as numbers of the lattice, and how many each has."""
        cut: list = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            cut += self._cut(text)
            ends[k + 1] = len(cut)
        at = np.fromiter(map(self.units.get, cut, itertools.repeat(-1)), np.int64, len(cut))
        missed = np.flatnonzero(at < 0)
        self.lattice.size = self.kept
        if len(missed):
            found = [cut[k] for k in missed.tolist()]
            new, first = list(dict.fromkeys(found)), len(self.units)
            of = np.fromiter(map(dict(zip(new, range(len(new)))).__getitem__, found), np.int64, len(missed))
            code = np.fromiter(map(hash, new), np.int64, len(new)) & (len(self.met) - 1)
            again = self.met[code] & np.array([type(u) is str and len(u) <= 64 for u in new])
            self.met[code] = True
            again &= self.kept[2] < self.cfg.kept_edges
            place = np.empty(len(new), np.int64)
            stay = np.flatnonzero(again)
            place[stay], place[~again] = np.arange(len(stay)), np.arange(len(stay), len(new))
            kept = [new[k] for k in stay.tolist()]
            self._add(kept, first)
            self.units.update(zip(kept, range(first, first + len(kept))))
            self.kept = self.lattice.size
            self._add([new[k] for k in np.flatnonzero(~again).tolist()], first + len(kept))
            at[missed] = first + place[of]
        size = self.word_count[at]
        sums = np.concatenate([[0], np.cumsum(size)])
        return _spans(self.word_at[at], size), sums[ends[1:]] - sums[ends[:-1]]

    def samples(self, texts: list[str | None], keys: np.ndarray) -> Iterator[tuple[int, Samples, np.ndarray, np.ndarray]]:
        """(rank, samples, ids, ids of each text), the most likely rank first."""
        words, counts = self._words(texts)
        lattice = self.lattice
        for rank, s in enumerate(Search(lattice, words, counts, keys, self.cfg.samples).run(), 1):
            ids, n = lattice.piece.take(s.edges), s.lengths
            unknown = np.flatnonzero(ids < 0)
            if len(unknown):  # their UTF-8 byte pieces
                raw = [chr(c).encode("utf-8", "surrogatepass") for c in lattice.point[lattice.start[s.edges[unknown]]].tolist()]
                width = np.ones(len(ids), np.int64)
                width[unknown] = [len(r) for r in raw]
                of = np.repeat(np.arange(len(s.text)), s.lengths)
                n = np.bincount(of, weights=width, minlength=len(s.text)).astype(np.int64)
                ids = np.repeat(ids, width)
                ids[ids < 0] = self.vocabulary.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            yield rank, s, ids, n


_vocabularies: dict[str, Vocabulary] = {}
_samplers: dict[tuple[str, SegmentationConfig], Sampler] = {}


def vocabulary(name: str) -> Vocabulary:
    """The vocabulary of a model file, one for each worker process. name: a path, or a file of the installed vocabularies."""
    if name not in _vocabularies:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _vocabularies[name] = Vocabulary(path)
    return _vocabularies[name]


def _runs(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    first, chars = 0, 0
    for k, t in enumerate(texts):
        if k > first and chars + len(t or "") > limit:
            yield first, k
            first, chars = k, 0
        chars += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def _each(docs: DataFrame, model: str, cfg: SegmentationConfig, column: str, make) -> DataFrame:
    """Rows of samples; make(ids, number of each text, vocabulary, targets, texts) gives the arrays of the columns named in column."""
    names = ["doc_id", "sample", *[c.split()[0] for c in column.split(",") if c.strip()], "log_prob", "inclusion"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        if (model, cfg) not in _samplers:  # one for each worker process, so that tasks share its lattices
            _samplers[model, cfg] = Sampler(v, cfg)
        sampler = _samplers[model, cfg]
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), row_keys(batch.column(0), cfg.seed)
            for lo, hi in _runs(texts, cfg.batch_chars):
                own, target = batch.column(0).slice(lo, hi - lo), v.targets(texts[lo:hi])
                for rank, s, ids, n in sampler.samples(texts[lo:hi], keys[lo:hi]):
                    more = make(ids, n, v, target, s.text)
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(s.text)), pa.array(np.full(len(s.text), rank, np.int32)), *more, pa.array(s.log_prob), pa.array(s.inclusion)], names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(rows, _SCHEMA.format(column))


def sample_segmentations(docs: DataFrame, model: str = "piece_bpe_32k.model", cfg: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """doc_id, sample (from 1), ids array<int>, log_prob, inclusion: up to cfg.samples rows for every row of docs (doc_id, text)."""

    def make(ids: np.ndarray, n: np.ndarray, v: Vocabulary, target: tuple, text: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return _each(docs, model, cfg, "ids array<int>,", make)


def decode(rows: DataFrame, model: str = "piece_bpe_32k.model", column: str = "text") -> DataFrame:
    """rows (ids array<int>, ...) with a column more: what the ids spell. A null list gives a null text; a column of that name must not be there yet."""
    if column in rows.columns:
        raise ValueError(f"the rows have a column {column!r}; name another one for the decoded text")
    rest = [c for c in rows.columns if c != "ids"]
    schema = T.StructType([*(rows.schema[c] for c in rest), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField(column, T.StringType())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else v.decode(x) for x in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, "ids", column])

    return rows.select(*(F.col(f"`{c}`") for c in rest), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(spell, schema)


def segmentation_digests(docs: DataFrame, model: str = "piece_bpe_32k.model", cfg: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """As sample_segmentations, with digests in place of the ids: n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip (the ids decode to the whole text)."""

    def make(ids: np.ndarray, n: np.ndarray, v: Vocabulary, target: tuple, text: np.ndarray) -> list[pa.Array]:
        end = (4 * np.cumsum(n)).tolist()
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[i:j]) for i, j in zip([0, *end], end)]
        return [pa.array(n), pa.array(crc, pa.int64()), pa.array(v.spells(ids, n, target, text))]

    return _each(docs, model, cfg, "n_tokens long, ids_crc32 long, round_trip boolean,", make)


def op4_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation_digests(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))
