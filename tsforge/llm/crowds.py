"""Pairs of a crowd of byte strings that may be within an edit distance, found 64 pairs at a time.

A bound of the distance by grams (runs of a few bytes). What an alignment within the limit leaves of the longer string x
lies in the shorter string y at a shift that the limit allows, since the way out and back is paid too. So a gram of x that
no such place of y holds is cut by an edit. An edit cuts grams that lie side by side, at most as many as a gram has bytes,
so of the grams that y lacks, from the left, each that no earlier edit reaches costs one more: a lower bound, exact for
this rule, and above the limit for nearly all strings that merely share an alphabet of syllables.

Strings lie in words of 64 by length. ``CELLS`` equal parts of x see one window of y each; a word keeps for each part and
gram which of its strings have it there, in 64 bits. A step takes one gram of many strings x against a word each: the 64
answers, the edits that are still in reach, and their counts (a bit of each count to a word) are all words, so a step is a
few operations on whole arrays. Grams are hashed to buckets; grams that meet there only lower the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CELLS = 16
#: Longest strings, with the bytes of a gram and the bits of its bucket; longer strings are not bounded.
GRAMS = ((768, 3, 11), (4096, 4, 13))
#: Words that are compared at once, and bytes of grams of words that are held.
JOBS, HELD = 1 << 12, 1 << 24
#: Steps of the bytes of a gram after which settled words are left out.
TURNS = 12
_FULL, _ONE = ~np.uint64(0), np.uint64(1)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each begin up to its end."""
    n = np.maximum(end - begin, 0)
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _below(k: np.ndarray) -> np.ndarray:
    """Words with the k lowest bits set."""
    return np.where(k >= 64, _FULL, (_ONE << np.clip(k, 0, 63).astype(np.uint64)) - _ONE)


def windows(limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the window of each cell as shares of y, over all longer strings x that the limit allows."""
    # A place i of x lies in y from i - (limit * nx + nx - ny) / 2 to i + (limit * nx - nx + ny) / 2: linear in nx.
    longer = np.array([1.0, 1 / (1 - limit)])[:, None]
    cell = np.arange(CELLS) / CELLS
    begin = longer * (cell - (1 + limit) / 2) + 0.5
    end = longer * (cell + 1 / CELLS - (1 - limit) / 2) + 0.5
    return begin.min(axis=0), end.max(axis=0)


def sift(
    raw: np.ndarray, start: np.ndarray, size: np.ndarray, region: np.ndarray, limit: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of strings of one region, x the later one, but for those whose distance is surely above ``limit`` of x.

    Strings are ordered by region and size; pairs whose sizes differ by more than the limit are left out."""
    most = (limit * size).astype(np.int64)
    place = region.astype(np.int64) * (int(size.max(initial=0)) + 1) + size
    first = np.searchsorted(place, place - most, side="left")
    mine, shortest = np.arange(len(size)), 0
    for longest, q, bits in GRAMS:
        x = mine[(size > shortest) & (size <= longest) & (first < mine)]
        shortest = longest
        if len(x):
            yield from _sifted(raw, start, size, most, first, x, q, bits, limit)
    x = mine[(size > shortest) & (first < mine)]
    for lo in range(0, len(x), JOBS):
        part = x[lo : lo + JOBS]
        yield np.repeat(part, part - first[part]), _ranges(first[part], part)


def _sifted(raw, start, size, most, first, x, q: int, bits: int, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the strings x with those from ``first`` on up to them."""
    # All strings that take part, one behind the other: their grams, and of each string where they begin.
    used = np.zeros(len(size) + 1, dtype=np.int64)
    np.add.at(used, first[x], 1)
    np.subtract.at(used, x + 1, 1)
    used = np.flatnonzero(np.cumsum(used[:-1]) > 0)
    size, many = size[used], np.maximum(size[used] - q + 1, 0)
    head = np.cumsum(many) - many
    inside = np.arange(many.sum()) - np.repeat(head, many)
    at = np.repeat(start[used], many) + inside
    gram = np.zeros(len(at), dtype=np.uint32)
    for k in range(q):
        gram |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    del at
    gram = (gram * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)).astype(np.int32)
    # A gram as the longer string looks for it: by its cell.
    sought = (inside * CELLS // np.repeat(size, many) << bits).astype(np.int32) + gram
    del inside

    x, first = np.searchsorted(used, x), np.searchsorted(used, first[x])
    words = (x - 1) // 64 - first // 64 + 1
    word = _ranges(first // 64, first // 64 + words)
    job = np.repeat(np.arange(len(x)), words)
    step = max(1, HELD // (CELLS << bits + 3))
    share = windows(limit)
    for lo in range(0, -(-len(used) // 64), step):
        here = np.flatnonzero((word >= lo) & (word < lo + step))
        if not len(here):
            continue
        rows = np.arange(64 * lo, min(64 * (lo + step), len(used)))
        kept = _kept(gram, head[rows], size[rows], many[rows], share, bits)
        here = here[np.argsort(size[x[job[here]]], kind="stable")]
        for part in np.split(here, range(JOBS, len(here), JOBS)):
            of, y = x[job[part]], word[part]
            wanted = _below(of - 64 * y) & ~_below(first[job[part]] - 64 * y)
            left = _left(wanted, kept, sought, (y - lo) * (CELLS << bits), head[of], many[of], most[used[of]], q)
            met = np.flatnonzero(left)
            slots = np.unpackbits(left[met].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, slot = np.nonzero(slots)
            yield used[of[met[row]]], used[64 * y[met[row]] + slot]


def _kept(gram: np.ndarray, head: np.ndarray, size: np.ndarray, many: np.ndarray, share, bits: int) -> np.ndarray:
    """For each word of 64 strings, cell and bucket, which of the strings have such a gram in the window of the cell."""
    out = np.zeros((-(-len(size) // 64) * CELLS) << bits, dtype=np.uint64)
    begin = np.maximum(np.floor(share[0] * size[:, None]).astype(np.int64) - 1, 0)
    end = np.minimum(np.ceil(share[1] * size[:, None]).astype(np.int64) + 2, many[:, None])
    base = (np.arange(len(size))[:, None] // 64 * CELLS + np.arange(CELLS)) << bits
    for slot in range(64):
        # One string of each word at a time, so that buckets that come twice get the same bit twice.
        b, e = begin[slot::64], end[slot::64]
        at = gram[_ranges((head[slot::64, None] + b).ravel(), (head[slot::64, None] + e).ravel())]
        at = at + np.repeat(base[slot::64].ravel(), np.maximum(e - b, 0).ravel())
        out[at] |= _ONE << np.uint64(slot)
    return out


def _left(wanted, kept, sought, base, head, many, most, q: int) -> np.ndarray:
    """For each string x (ascending by size) and word, the wanted strings that are not known to take more than ``most`` edits."""
    # Counts begin so that the edit after the last allowed one carries out of the highest bit.
    levels = max(1, int(most.max()).bit_length())
    counts = [np.where((1 << levels) - 1 - most >> k & 1, _FULL, np.uint64(0)) for k in range(levels)]
    # Grams that the last edits reach: the next one, the one after it and so on.
    reach = [np.zeros(len(head), dtype=np.uint64) for _ in range(q)]
    out, job = wanted.copy(), np.arange(len(head))
    left, turn = wanted, 0
    for t in range(0, int(many.max()) - q + 1, q):
        live = int(np.searchsorted(many, t + q, side="left"))
        place, near = head[live:] + t, base[live:]
        edits = np.zeros(len(place), dtype=np.uint64)
        for _ in range(q):
            new = kept.take(sought.take(place) + near)
            new |= reach[0][live:]
            np.invert(new, out=new)
            for k in range(q - 1):
                np.bitwise_or(reach[k + 1][live:], new, out=reach[k][live:])
            edits |= new
            place += 1
        # Of q grams side by side at most one costs an edit.
        for count in counts:
            carry = count[live:] & edits
            count[live:] ^= edits
            edits = carry
        left[live:] &= ~edits
        turn += 1
        if turn % TURNS == 0:
            open_ = left != 0
            open_[:live] = False
            if 4 * np.count_nonzero(open_) < 3 * len(open_):
                # What is settled goes; of strings that end here the answer stays.
                out[job] = left
                job, left, base, head, many = (x[open_] for x in (job, left, base, head, many))
                counts, reach = [x[open_] for x in counts], [x[open_] for x in reach]
                if not len(job):
                    return out
    out[job] = left
    return out
