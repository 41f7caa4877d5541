"""Vectorised text primitives on Arrow string batches: words, word hashes, shingle sets.

All of it works on the UTF-8 bytes of many texts at once. Word separators are ASCII, so no
character is ever cut. Hashes are 64 bits: a mixing step after every eight bytes, started from the
length, and BLAKE2b for long spans; equal strings have equal hashes everywhere and in every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# The separators of `[^\x20\x09-\x0D]+`, and odd 64-bit multipliers.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM = np.array(
    [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD],
    dtype=np.uint64,
)
#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE = 1 << 20

_SEPARATOR = np.isin(np.arange(256), SEPARATORS)
#: Separators where words are letters and digits: white space and all ASCII punctuation and controls.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that stay of a last block of this many bytes.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Blocks of a span that are mixed one after the other; longer spans take a digest.
LONGEST = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: What hashes of short spans start from, by length.
_START = mix(np.arange(256, dtype=np.uint64) * GRAM[0] + GRAM[1])


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


@dataclass
class Words:
    """Words of a slice: byte ranges, the text each belongs to, and words per text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray


def words(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> Words:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts of a slice, or other separators' words."""
    n = len(raw)
    docs = len(offsets) - 1
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, np.zeros(docs, dtype=np.int64))
    inside = ~separator[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begin[edges] = inside[edges]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    finish[edges] = inside[edges]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    bound = np.searchsorted(start, offsets)
    count = np.diff(bound)
    return Words(start, end, np.repeat(np.arange(docs), count), count)


def word_hashes(raw: np.ndarray, w: Words, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word; ``lower`` folds A-Z first."""
    return span_hashes(_LOWER[raw] if lower else raw, w.start, w.end)


def _chained(
    n: np.ndarray, blocks: np.ndarray, load: Callable[[np.ndarray, int], np.ndarray], whole: Callable[[int], bytes]
) -> np.ndarray:
    """Start from lengths ``n`` and mix in ``blocks`` blocks, all spans a block at a time."""
    h = _START[n] if not len(n) or n.max() < len(_START) else mix(n.astype(np.uint64) * GRAM[0] + GRAM[1])
    live, k = np.flatnonzero((blocks > 0) & (blocks <= LONGEST)), 0
    while len(live):
        if len(live) == len(h):
            h = mix(h ^ load(live, k))
        else:
            h[live] = mix(h[live] ^ load(live, k))
        k += 1
        live = live[blocks[live] > k]
    for i in np.flatnonzero(blocks > LONGEST).tolist():
        h[i] = np.frombuffer(hashlib.blake2b(whole(i), digest_size=8).digest(), dtype="<u8")[0]
    return h


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash per byte range, the same wherever the range lies."""
    n = end - start
    # Eight bytes from every place on; the view is not aligned, what is taken from it is.
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))

    def load(live: np.ndarray, k: int) -> np.ndarray:
        return eight[start[live] + 8 * k] & _TAIL[np.minimum(n[live] - 8 * k, 8)]

    return _chained(n, -(-n // 8), load, lambda i: raw[start[i] : end[i]].tobytes())


def sequence_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One 64-bit hash per range of hashes."""
    n = last - first
    return _chained(n, n, lambda live, k: h[first[live] + k], lambda i: h[first[i] : last[i]].tobytes())


def grams(h: np.ndarray, w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every window of ``n`` words inside one text."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(w.doc[: len(h) - n + 1] == w.doc[n - 1 :])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        total += h[at + k] * GRAM[k % len(GRAM)]
    return mix(total), at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each text, lower-cased A-Z, as (hashes, offsets).

    Hashes are sorted within a text. A text of fewer words has its whole sequence as its one
    shingle; a text without words has none.
    """
    w = words(raw, offsets)
    h = word_hashes(raw, w, lower=True)
    g, at = grams(h, w, n)
    doc = w.doc[at] if len(at) else np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        first = np.cumsum(w.count) - w.count
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            has = w.count[short] > k
            extra[has] += h[first[short[has]] + k] * GRAM[k % len(GRAM)]
        g = np.r_[g, mix(extra ^ (w.count[short].astype(np.uint64) * BASE))]
        doc = np.r_[doc, short]
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    edges = np.searchsorted(doc, np.arange(len(offsets)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        g[a:b].sort()
    if len(g):
        keep = np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]
        g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(len(offsets)))


def set_hashes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash per set, equal for equal sets; 0 for the empty set."""
    n = np.diff(at)
    total = np.zeros(len(sets) + 1, dtype=np.uint64)
    np.cumsum(mix(sets ^ BASE), out=total[1:])
    out = mix((total[at[1:]] - total[at[:-1]]) + n.astype(np.uint64) * GRAM[1])
    out[out == 0] = 1
    out[n == 0] = 0
    return out
