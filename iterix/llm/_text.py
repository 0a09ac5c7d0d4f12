"""Byte-level text primitives shared by the text operators.

Texts arrive as Arrow batches. Words are the maximal runs of bytes other than
ASCII white space, hashed to 64 bits with whole-batch numpy arithmetic, so no
Python object is made per word. Work arrays are bounded: a batch is cut into
chunks of whole documents, and a long document is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(raw: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last + 1, bytes, offsets) of runs of documents of about limit bytes; one larger document comes alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and where each starts."""
    hashes, starts, i, n = [], [], 0, len(raw)
    while i < n:
        j = min(n, i + CHUNK_BYTES)
        while j < n:  # a piece ends at white space
            gap = np.flatnonzero(SPACE[raw[j : j + 4096]])
            j = min(n, j + (int(gap[0]) if len(gap) else 4096))
            if len(gap):
                break
        piece = raw[i:j]
        space = SPACE[piece]
        begin = ~space
        begin[1:] &= space[:-1]
        inner = off[(off > i) & (off < j)] - i
        begin[inner] = ~space[inner]
        at = np.flatnonzero(begin)
        if len(at):
            piece, space = piece[at[0] :], space[at[0] :]
            lengths = np.diff(at, append=at[0] + len(piece))
            rel = np.arange(len(piece)) - np.repeat(at - at[0], lengths)
            value = (piece.astype(np.uint64) + _U(1)) * powers(int(lengths.max()))[rel]
            value[space] = 0
            hashes.append(mix(np.add.reduceat(value, at - at[0])))
            starts.append(at + i)
        i = j
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def word_docs(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.searchsorted(off, starts, "right") - 1


def occurrence(key: np.ndarray) -> np.ndarray:
    """How often each value came earlier in the array."""
    order = np.argsort(key, kind="stable")
    run = key[order]
    first = np.ones(len(run), dtype=bool)
    first[1:] = run[1:] != run[:-1]
    at = np.flatnonzero(first)
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.arange(len(run)) - np.repeat(at, np.diff(at, append=len(run)))
    return out


def elements(raw: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Word shingles as (32-bit element, document), in document order.

    The k-th occurrence of a shingle in a document is an element of its own, so
    that a set of elements with a weight by shingle is the bag of shingles with
    term-frequency weights. A text of fewer words than width is one shingle.
    """
    words, starts = word_hashes(raw, off)
    doc = word_docs(starts, off)
    if not len(words):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n = np.bincount(doc, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    padded = np.concatenate([words, np.zeros(width - 1, np.uint64)])
    docs = np.concatenate([doc, np.full(width - 1, -1)])
    shingle = np.zeros(len(words), np.uint64)
    for k in range(width):
        part = padded[k : k + len(words)] * _U((0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15 * 2 * k) & (2**64 - 1))
        shingle += np.where(docs[k : k + len(words)] == doc, part, _U(0))
    short = first[(n > 0) & (n < width)]
    whole = docs[width - 1 :] == doc
    whole[short] = True
    shingle, doc = mix(shingle[whole]), doc[whole]
    nth = occurrence(mix(shingle + doc.astype(np.uint64) * _U(0xA0761D6478BD642F)))
    return (mix(shingle + nth.astype(np.uint64) * _U(0xE7037ED1A0B428DB)) >> _U(32)).astype(np.uint32), doc
