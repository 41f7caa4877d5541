"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups.

A line is normalised (A-Z folded; white space and ASCII punctuation collapse to one space) and
gets a 64-bit SimHash in ``BLOCKS`` blocks. A word votes in one block only, that of its first two
bytes, so an edit of one word changes at most two blocks and leaves the others equal to the bit,
however short the line. A line goes to one region for every choice of ``BLOCKS - EDITED`` blocks
(a key of 38 bits at every size of the input), so by the pigeonhole principle two lines meet
whose edits touch at most ``EDITED`` blocks: one word replaced, changed, inserted or left out
always, changes inside several words of these blocks too. More edits are met where they happen
to leave three blocks equal. A key needs ``KEY_BYTES`` bytes of words in its blocks, since less
says too little. All pairs that meet are verified, with no bound on SimHash bits: the edit
distance of the normalised lines may be at most ``LIMIT`` of the longer one. Equal lines are one
item. Of each connected group one occurrence stays in the corpus: the first line of the group in
the document with the smallest id. Lines of fewer than ``MIN_BYTES`` normalised bytes link with
equal lines only; lines without a word stay, whatever they are.

Recall, held by ``tests/llm/test_lines.py`` against a plain edit distance, for lines with one word edited that are at
a similarity of 0.8 or more: at least 0.9 from ten words on, at least 0.8 below (measured 39 of 45 with a word
replaced). Lines with edits in many words, and scripts without spaces, where a line is one word, are often not met.

Defined results: null and empty texts have no lines. A row without an id is ordered by a hash of
its text; rows that repeat an id are one document and keep the same lines. Other columns are
kept (one named like an output column is replaced); ``n_chars`` is not touched here. Texts and lines of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import crowds
from tsforge.llm import text as tx
from tsforge.llm.base import materialise, query, table
from tsforge.llm.quality import lines_of
from tsforge.llm.regions import Space, connect, passes, sieve

BLOCKS, EDITED, LIMIT, MIN_BYTES, KEY_BYTES = 5, 2, 0.2, 16, 8
#: First bits of the blocks, and the choices of blocks that make keys.
EDGES = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
CHOICES = list(combinations(range(BLOCKS), BLOCKS - EDITED))
#: Bytes of texts whose lines are hashed at once; what that takes stays in a CPU's cache.
PART = 1 << 18
#: Words whose votes are held at once.
VOTES = 1 << 14
#: Lines that a task keeps from giving twice.
SEEN = 1 << 16
#: Where the number of a key's choice begins; it leads, so that of regions with the same members the first choice stays.
CHOICE_AT = 59
#: Share of the longer line that a bound on the distance looks at: of its beginning, and of blocks all over it.
SHARE, BLOCK_SHARE = 0.32, 0.44
#: Words of pairs that are bounded at once, and pairs below which the bound of beginnings costs more than the distance.
LANES, FEWEST = 1 << 12, 2
#: Bytes of lines for each column of the bound of blocks below which it costs more than the distances.
COLUMN = 15
#: Rows of a region above which a bound by grams sifts its pairs, and bytes of regions that are sifted together.
CROWD, SIFTED = 32, 2 << 20
#: The last bit of a word.
_LAST = np.uint64(63)
#: Bytes that must be equal again behind an edit, and how far behind it they are looked for.
ANCHOR, GAPS = 8, (0, 1, 2, 4, 7, 10, 14, 20, 32, 64)
#: Symbols of the bound: letters, digits and the space by themselves, other bytes a few to one.
SYMBOLS = np.array([ord_ % 27 + 37 for ord_ in range(256)], dtype=np.int64)
SYMBOLS[97:123], SYMBOLS[48:58], SYMBOLS[32] = np.arange(26), np.arange(26, 36), 36
#: The block of a word by its first two bytes; places of the blocks' last bits, and what a block's bits lack of 16.
BLOCK_OF = (tx.mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BLOCKS)).astype(np.int64)
SHIFT, _SPARE = 64 - np.array(EDGES[1:], dtype=np.uint64), 16 - np.diff(EDGES).astype(np.uint64)
_FOLDED = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_NORMAL = np.where(tx.PUNCTUATION, 32, _FOLDED).astype(np.uint8)
#: The bits of a byte, highest first, in a byte each.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).view(np.uint64).ravel()
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def normalise(line: bytes) -> bytes:
    """Words of the line, A-Z folded, with single spaces."""
    return _GAP.sub(b" ", line.lower()).strip()


def _line_ids(word_hash: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One 64-bit hash per range of words, which lie one behind the other: a sum of mixed pairs of a word and its place."""
    n = last - first
    place = np.arange(len(word_hash)) - np.repeat(first, n)
    total = np.zeros(len(word_hash) + 1, dtype=np.uint64)
    np.cumsum(tx.mix(word_hash + place.astype(np.uint64) * tx.GRAM[0]), out=total[1:])
    return tx.mix(total[last] - total[first] + n.astype(np.uint64) * tx.GRAM[1])


def worded_lines(raw: np.ndarray, offsets: np.ndarray, hashed: list | None = None) -> tuple[np.ndarray, ...]:
    """(begin, end, text, id, words, first word, normalised bytes, all words) of every line with a word.

    The hashes of the words are added to ``hashed``."""
    w = tx.words(raw, offsets, tx.PUNCTUATION)
    begin, end, doc = lines_of(raw, offsets)
    word_hash = tx.word_hashes(raw, w, lower=True)
    if hashed is not None:
        hashed.append(word_hash)
    first, last = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    ids, n = _line_ids(word_hash, first, last), last - first
    total = np.r_[0, np.cumsum(w.end - w.start)]
    use = n > 0
    size = (total[first + n] - total[first] + n - 1)[use]
    return begin[use], end[use], doc[use], ids[use], n[use], first[use], size, w


def _ones(bits: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How often each bit, lowest byte first and highest bit of a byte first, is set in the hashes of each range."""
    octets = bits.view(np.uint8).reshape(len(bits), -1)
    # Eight counts of a byte each are added at once, over at most 255 words; what sums of all carry on is taken off again.
    n = np.diff(np.r_[begin, len(octets)])
    parts = -(-n // 255)
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.r_[np.repeat(begin, parts) + 255 * inside, len(octets)]
    total = np.zeros((len(octets) + 1, octets.shape[1]), dtype=np.uint64)
    np.cumsum(SPREAD[octets], axis=0, out=total[1:])
    ones = (total[at[1:]] - total[at[:-1]]).view(np.uint8).reshape(len(at) - 1, -1)
    return ones if len(ones) == len(n) else np.add.reduceat(ones, np.cumsum(parts) - parts, axis=0, dtype=np.int32)


def simhashes(
    raw: np.ndarray, w: tx.Words, first: np.ndarray, n: np.ndarray, word_hash: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each line, a majority for each bit among the words of its block, and which choices have a key."""
    hashes, usable = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.int64)
    if not len(n):
        return hashes, usable
    # A hash's lowest byte comes first, as in the numbers that go out.
    word_hash = (tx.word_hashes(raw, w, lower=True) if word_hash is None else word_hash).byteswap()
    length = w.end - w.start
    second = np.where(length > 1, raw[np.minimum(w.start + 1, len(raw) - 1)], 0)
    block = BLOCK_OF[_FOLDED[raw[w.start]].astype(np.int64) * 256 + _FOLDED[second]]
    total = np.cumsum(n)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(total, total[start] - n[start] + VOTES, side="right")))
        many = n[start:stop]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        word = np.repeat(first[start:stop], many) + inside
        # The words of a block of a line lie together; only the block's own bits are counted.
        at = np.repeat(np.arange(len(many)), many) * BLOCKS + block[word]
        order = np.argsort(at.astype(np.uint16) if len(many) * BLOCKS < 1 << 16 else at, kind="stable")
        word, at = word[order], at[order]
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        cell, own = at[begin], block[word]
        ones = _ones((word_hash[word] >> SHIFT[own] << _SPARE[own]).astype(">u2"), begin)
        voters = np.diff(np.r_[begin, len(at)])
        bits = np.packbits(2 * ones.astype(np.int32) > voters[:, None], axis=1).view(">u2").ravel().astype(np.uint64)
        blocks, size = np.zeros(len(many) * BLOCKS, dtype=np.uint64), np.zeros(len(many) * BLOCKS, dtype=np.int64)
        blocks[cell] = bits >> _SPARE[block[word[begin]]] << SHIFT[block[word[begin]]]
        size[cell] = np.add.reduceat(length[word], begin)
        hashes[start:stop] = blocks.reshape(-1, BLOCKS).sum(axis=1, dtype=np.uint64)
        size = size.reshape(-1, BLOCKS)
        for k, chosen in enumerate(CHOICES):
            usable[start:stop] |= (size[:, list(chosen)].sum(axis=1) >= KEY_BYTES).astype(np.int64) << k
        start = stop
    return hashes, usable


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` if it is larger (bit-parallel, in a band of rows)."""
    if a == b:
        return 0
    short = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = np.flatnonzero(x[:short] != y[:short])
    head = int(differ[0]) if len(differ) else short
    x, y = x[head:], y[head:]
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[len(x) - short :][::-1] != y[len(y) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = x[: len(x) - tail].tobytes(), y[: len(y) - tail].tobytes()
    if len(a) > len(b):
        a, b = b, a
    if not a or len(b) - len(a) > most:
        return min(len(b), most + 1) if not a else most + 1
    at: dict[int, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << k)
    # Rows that an alignment within the limit meets: what lies off the last diagonal is paid on the way out and back.
    over, under = (most + len(b) - len(a)) // 2, (most - len(b) + len(a)) // 2
    first = last = top = plus = minus = score = 0
    for lo in range(0, len(b), 64):
        part = b[lo : lo + 64]
        past, first = first, min(max(first, lo - over), len(a))
        # Rows above the window only add one a column, those that are new in it one a row.
        gone = (1 << first - past) - 1
        top += (plus & gone).bit_count() - (minus & gone).bit_count() + len(part)
        plus, minus = plus >> first - past, minus >> first - past
        past, last = last, min(len(a), lo + 64 + under)
        full = (1 << last - first) - 1
        plus |= full ^ ((1 << max(past - first, 0)) - 1)
        mine = {c: at.get(c, 0) >> first & full for c in set(part)}
        for same in [mine[c] for c in part]:
            vertical = same | minus
            across = (((same & plus) + plus) ^ plus) | vertical
            up = ((minus | ~(across | plus)) << 1) | 1
            minus, plus = full & up & across, full & (((plus & across) << 1) | ~(across | up))
        # Down this column; each byte that is left takes one off at most.
        score = top + plus.bit_count() - minus.bit_count()
        if last == len(a) and score - (len(b) - lo - len(part)) > most:
            return most + 1
    return min(score, most + 1)


def _prefix_bound(raw: np.ndarray, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, most: np.ndarray, words: int) -> np.ndarray:
    """A lower bound of the edit distance of the pairs of lines at x and y, exact up to ``most`` for a first line of at most
    ``64 * words`` bytes: the first so many bytes of the first line against all beginnings of the second, and what the lengths
    of the rests differ by. First lines have more than ``64 * (words - 1)`` bytes. All pairs go a column at a time, and their
    words too, each a column behind the word before it, whose carry it needs."""
    n, pair = len(x), np.arange(len(x))
    p = np.minimum(64 * words, nx)
    at = np.zeros((words, 64 * n), dtype=np.uint64)
    for i in range(min(64 * words, int(nx.max()))):
        bit = (i < nx).astype(np.uint64) << np.uint64(i % 64)
        at[i // 64][SYMBOLS[raw[x + np.minimum(i, nx - 1)]] * n + pair] |= bit
    at = at.ravel()
    columns = np.minimum(ny, p + most)
    most_columns, ahead = int(columns.max()), words - 1
    word = np.arange(words)[:, None] * (64 * n)
    plus, minus = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), dtype=np.uint64)
    more, less = np.zeros((words + 1, n), dtype=np.uint64), np.zeros((words + 1, n), dtype=np.uint64)
    more[0] = 1
    one, last = np.uint64(1), np.full((words, n), 63, dtype=np.uint64)
    last[-1] = p - 1 - 64 * ahead
    score, rest = p.astype(np.uint64), nx - p
    best = p + np.abs(rest - ny)
    early = int((p - most).min())
    held = np.zeros((ahead, n), dtype=np.int64)
    for lo in range(0, most_columns + ahead, 64):
        column = np.arange(lo, min(lo + 64, most_columns + ahead))[:, None]
        # Columns of this turn, behind those that later words still need.
        places = np.concatenate([held, SYMBOLS[raw[y + np.minimum(column, ny - 1)]] * n + pair])
        held = places[len(places) - ahead :]
        for k, j in enumerate(column.ravel().tolist(), ahead):
            # Words that have begun.
            w = min(words, j + 1)
            up_in, down_in, above, below = more[:w], less[:w], plus[:w], minus[:w]
            same = at.take(places[k - w + 1 : k + 1][::-1] + word[:w])
            vertical = same | below
            same |= down_in
            across = (((same & above) + above) ^ above) | same
            up, down = below | ~(across | above), above & across
            more_out, less_out = up >> last[:w] & one, down >> last[:w] & one
            up, down = up << one | up_in, down << one | down_in
            plus[:w], minus[:w] = down | ~(vertical | up), up & vertical
            more[1 : w + 1], less[1 : w + 1] = more_out, less_out
            j -= ahead
            if j >= 0:
                score += more[words]
                score -= less[words]
                if j + 1 >= early:
                    bound = score.view(np.int64) + np.abs(rest - (ny - 1 - j))
                    # Behind the last column of a pair its best stays.
                    best = np.minimum(best, np.where(j < columns, bound, best))
    return best


def _block_bound(raw: np.ndarray, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance of the pairs of lines at x and y where that is at most ``most``; else it may be above.

    Blocks of 64 bytes of the first line, dealt evenly over it, of at least 64 bytes and no shorter than the second. An alignment
    within ``most`` edits has to come back to the ends of both lines, so it pairs a block with bytes of a window of the second line;
    what the block is away from the nearest of all stretches there is spent inside the block. Blocks share no byte, so their shares
    add up. All blocks of all pairs go a column at a time, those of the widest windows last."""
    many = np.minimum(nx // 64, np.ceil(BLOCK_SHARE * nx / 64).astype(np.int64))
    pair = np.repeat(np.arange(len(x)), many)
    inside = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
    begin = inside * (nx - 64)[pair] // np.maximum(many - 1, 1)[pair]
    # Diagonals that leave enough edits for the way back to the last one.
    right, left = (most - (nx - ny)) // 2, (most + (nx - ny)) // 2
    first = np.maximum(0, begin - left[pair])
    columns = np.maximum(np.minimum(ny[pair], begin + 64 + right[pair]) - first, 0)
    order = np.argsort(-columns, kind="stable")
    pair, begin, first, columns = pair[order], begin[order], first[order], columns[order]
    n, one = len(pair), np.uint64(1)
    lane, column = np.arange(n) * 64, y[pair] + first - 1
    at = np.zeros(64 * n, dtype=np.uint64)
    for i in range(64):
        at[lane + SYMBOLS[raw[x[pair] + begin + i]]] |= one << np.uint64(i)
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, dtype=np.uint64)
    score, best = np.full(n, 64, dtype=np.uint64), np.full(n, 64, dtype=np.uint64)
    live = n
    for j in range(int(columns[0]) if n else 0):
        if columns[live - 1] <= j:
            live = int(np.searchsorted(-columns, -j, side="left"))
        above, below, now = plus[:live], minus[:live], score[:live]
        column[:live] += 1
        place = SYMBOLS.take(raw.take(column[:live]))
        place += lane[:live]
        same = at.take(place)
        vertical = same | below
        across = same & above
        across += above
        across ^= above
        across |= same
        up = across | above
        np.invert(up, out=up)
        up |= below
        across &= above
        now += up >> _LAST
        now -= across >> _LAST
        np.minimum(best[:live], now, out=best[:live])
        up <<= one
        across <<= one
        np.bitwise_and(up, vertical, out=below)
        vertical |= up
        np.invert(vertical, out=vertical)
        np.bitwise_or(across, vertical, out=above)
    return np.bincount(pair, weights=best.astype(np.float64), minlength=len(x)).astype(np.int64)


def surely_apart(raw: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of lines a bound of their distance keeps apart: that of beginnings for lines that one word of it bounds, else that
    of blocks. Pairs too few for the columns that they need are left open."""
    first = size[a] >= size[b]
    x, y = np.where(first, a, b), np.where(first, b, a)
    most = (LIMIT * size[x]).astype(np.int64)
    out = np.zeros(len(a), dtype=bool)
    order = np.argsort(size[x], kind="stable")
    short = int(np.searchsorted(SHARE * size[x][order], 64, side="right"))
    for lo in range(0, short if short >= FEWEST else 0, LANES):
        k = order[lo : min(lo + LANES, short)]
        out[k] = _prefix_bound(raw, start[x[k]], size[x[k]], start[y[k]], size[y[k]], most[k], 1) > most[k]
    total, lo = np.cumsum(BLOCK_SHARE * size[x][order] / 64), short
    while lo < len(order):
        base = total[lo - 1] if lo else 0.0
        hi = max(lo + 1, int(np.searchsorted(total, base + LANES, side="right")))
        # The longest lines set the columns; without enough like them they are left out.
        bytes_ = np.cumsum(size[x][order[lo:hi]])
        worth = np.flatnonzero(bytes_ >= COLUMN * (64 + most[order[lo:hi]]))
        k = order[lo : lo + int(worth[-1]) + 1] if len(worth) else order[:0]
        out[k] = _block_bound(raw, start[x[k]], size[x[k]], start[y[k]], size[y[k]], most[k]) > most[k]
        lo = hi
    return out


def surely_alike(a: bytes, b: bytes, most: int) -> bool:
    """Whether an alignment of at most ``most`` edits is found at once: equal stretches, and between them what the next ``ANCHOR``
    bytes of one line that lie near in the other leave out. False says nothing."""
    i = j = cost = 0
    while True:
        n = min(len(a) - i, len(b) - j)
        if a[i : i + n] == b[j : j + n]:
            return cost + max(len(a) - i, len(b) - j) - n <= most
        # The length of the equal stretch, by halves.
        lo, hi = 0, n
        while hi - lo > 1:
            middle = (lo + hi) // 2
            if a[i + lo : i + middle] == b[j + lo : j + middle]:
                lo = middle
            else:
                hi = middle
        i, j = i + lo, j + lo
        if cost + max(len(a) - i, len(b) - j) <= most:
            return True
        for gap in GAPS:
            anchor = a[i + gap : i + gap + ANCHOR]
            at = b.find(anchor, j, j + gap + GAPS[-1]) if len(anchor) == ANCHOR else -1
            if at >= 0:
                cost += max(gap, at - j)
                i, j = i + gap, at
                break
        else:
            return False
        if cost > most:
            return False


def line_distance(a: bytes, b: bytes) -> float:
    """Edit distance as a share of the longer line; 1 where it is surely above the limit."""
    longer = max(len(a), len(b))
    most = int(LIMIT * longer)
    d = edit_distance(a, b, most)
    return d / longer if longer and d <= most else float(d > 0)


def masks() -> list[int]:
    """Bit masks of the choices of blocks, as signed 64-bit numbers."""
    block = [((1 << 64 - a) - 1) ^ ((1 << 64 - b) - 1) for a, b in zip(EDGES, EDGES[1:])]
    out = [sum(block[k] for k in chosen) for chosen in CHOICES]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def like_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths that an edit distance within the limit allows."""
    return np.abs(a - b) <= LIMIT * np.maximum(a, b)


def _occurrences(column: pa.Array) -> pa.Array:
    """Distinct lines of each text: (id, simhash, choices that have a key, length, whether the text holds it again)."""
    kind = pa.struct([("id", pa.int64()), ("bits", pa.int64()), ("usable", pa.int32()), ("size", pa.int32()), ("again", pa.bool_())])
    parts, counts = [], [np.zeros(0, dtype=np.int64)]
    for _, raw, offsets in tx.slices(column, PART):
        hashed: list[np.ndarray] = []
        _, _, doc, key, n, first, size, w = worded_lines(raw, offsets, hashed)
        order = np.lexsort((key, doc))
        head = np.flatnonzero(np.r_[True, (np.diff(doc[order]) != 0) | (key[order][1:] != key[order][:-1])][: len(order)])
        fresh, again = order[head], np.diff(np.r_[head, len(order)]) > 1
        bits, usable = simhashes(raw, w, first[fresh], n[fresh], *hashed)
        usable[size[fresh] < MIN_BYTES] = 0
        numbers = key[fresh].view(np.int64), bits.view(np.int64), usable.astype(np.int32), size[fresh].astype(np.int32)
        parts.append((*numbers, again))
        counts.append(np.bincount(doc[fresh], minlength=len(offsets) - 1))
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, dtype=f.type.to_pandas_dtype()) for f in kind]
    flat = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)), flat)


def _bodies(told: np.ndarray, raw: np.ndarray, w: tx.Words, first: np.ndarray, n: np.ndarray, size: np.ndarray) -> pa.Array:
    """``told`` and the normalised line of each line, of ``n`` words from ``first`` on and ``size`` bytes; lines ascend."""
    word = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    stop = w.end[word] + 1
    # Behind a word stands a space, but for the last one.
    stop[np.cumsum(n) - 1] -= 1
    edge = np.zeros(len(raw) + 1, dtype=np.int8)
    edge[w.start[word]] = 1
    edge[stop] -= 1
    text = _NORMAL[raw[np.cumsum(edge[:-1], dtype=np.int8) > 0]]
    offsets = np.r_[0, np.cumsum(size + 16)]
    out = np.empty(offsets[-1], dtype=np.uint8)
    head = np.zeros(len(out), dtype=bool)
    head[(offsets[:-1, None] + np.arange(16)).ravel()] = True
    out[head], out[~head] = told.view(np.uint8).ravel(), text
    data = pa.py_buffer(out)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), data]).cast(pa.binary())


def _line_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, body): SimHash and choices that have a key (8 bytes each), then the normalised line of each id, and of few others."""
    words = docs.sparkSession.sparkContext.broadcast(sieve(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            for _, raw, offsets in tx.slices(batch.column("text"), PART):
                hashed: list[np.ndarray] = []
                _, _, _, key, n, first, size, w = worded_lines(raw, offsets, hashed)
                use = np.flatnonzero(passes(words.value, key))
                use = use[np.sort(np.unique(key[use], return_index=True)[1])]
                use = use[[i not in seen for i in key[use].tolist()]] if len(use) else use
                seen.update(key[use].tolist())
                told = np.stack([x.view(np.uint64) for x in simhashes(raw, w, first[use], n[use], *hashed)], axis=1)
                body = _bodies(told, raw, w, first[use], n[use], size[use])
                yield pa.RecordBatch.from_arrays([pa.array(key[use].view(np.int64)), body], names=["id", "body"])

    return docs.select("text").mapInArrow(run, "id long, body binary").repartition("id").dropDuplicates(["id"])


def _members(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, length) of each choice of blocks that a line has a key for."""
    ids, bits, usable, size = (batch.column(c).to_numpy() for c in ("id", "bits", "usable", "size"))
    low, found = np.uint64((1 << CHOICE_AT) - 1), []
    for k, m in enumerate(masks()):
        rows = np.flatnonzero(usable >> k & 1)
        key = (tx.mix((bits[rows] & m).view(np.uint64)) & low).view(np.int64) + (k << CHOICE_AT)
        found.append((key, ids[rows], size[rows].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


class Lines:
    """Normalised lines as a judge of links.

    Two lines that meet in several regions are compared in that of their first choice of blocks, which no other
    region of the same members replaces. Crowds are sifted by their grams. Most pairs that link show it by equal
    stretches, most that do not are told apart many at a time by their beginnings; the others take an edit distance."""

    step, crowd = 1, CROWD

    def __init__(self, body: np.ndarray, key: np.ndarray):
        self.choice = key >> CHOICE_AT
        told = np.frombuffer(b"".join([x[:16] for x in body.tolist()]), dtype=np.int64).reshape(-1, 2)
        self.bits, self.usable = told[:, 0], told[:, 1]
        self.lines = [x[16:] for x in body.tolist()]
        self.size = np.fromiter(map(len, self.lines), dtype=np.int64, count=len(body))
        self.raw, self.start = np.frombuffer(b"".join(self.lines), dtype=np.uint8), np.cumsum(self.size) - self.size
        ends = np.stack([self.start, np.maximum(self.start + self.size - 8, 0)], axis=1)
        #: The first and the last eight bytes of each line, of a shorter one with bytes next to it.
        self.ends = self.raw[np.minimum(ends[:, :, None] + np.arange(8), max(len(self.raw) - 1, 0))].view(np.uint64)[:, :, 0]
        #: Pairs of the last call of ``may`` that surely link, as one number each.
        self.alike: set[int] = set()

    def sift(self, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        total = np.cumsum([self.size[b:e].sum() for b, e in zip(begin.tolist(), end.tolist())])
        lo = 0
        while lo < len(begin):
            # Whole regions of SIFTED bytes, since their grams take many times that.
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SIFTED, side="right")))
            rows = np.concatenate([np.arange(b, e) for b, e in zip(begin[lo:hi].tolist(), end[lo:hi].tolist())])
            region = np.repeat(np.arange(lo, hi), end[lo:hi] - begin[lo:hi])
            order = np.lexsort((self.size[rows], region))
            rows = rows[order]
            for a, b in crowds.sift(self.raw, self.start[rows], self.size[rows], region[order], LIMIT):
                yield rows[a], rows[b]
            lo = hi

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        differ, usable = self.bits[a] ^ self.bits[b], self.usable[a] & self.usable[b]
        for k, m in enumerate(masks()[:-1]):
            out &= (self.choice[a] <= k) | ((differ & m) != 0) | ((usable >> k & 1) == 0)
        first = np.flatnonzero(out)
        most = (LIMIT * np.maximum(self.size[a[first]], self.size[b[first]])).astype(np.int64)
        # Most pairs that link begin or end alike; the others wait for the bound, which leaves few of them.
        ends = (self.ends[a[first]] == self.ends[b[first]]).any(axis=1)
        self.alike = set()
        left = self._unlike(a, b, first[ends], most[ends])
        wait = np.r_[left, first[~ends]]
        out[wait] = ~surely_apart(self.raw, self.start, self.size, a[wait], b[wait])
        late = ~ends & out[first]
        self._unlike(a, b, first[late], most[late])
        return out

    def _unlike(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which of the pairs at these places do not link at once; the others are kept as alike."""
        pairs = zip(a[at].tolist(), b[at].tolist(), most.tolist())
        alike = np.fromiter((surely_alike(self.lines[i], self.lines[j], d) for i, j, d in pairs), dtype=bool, count=len(at))
        self.alike.update((a[at[alike]] * len(self.lines) + b[at[alike]]).tolist())
        return at[~alike]

    def links(self, i: int, rest: np.ndarray) -> np.ndarray:
        at = i * len(self.lines)
        alike = [at + j in self.alike or line_distance(self.lines[i], self.lines[j]) <= LIMIT for j in rest.tolist()]
        return np.array(alike, dtype=bool)


def _cut(raw: np.ndarray, offsets: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The texts without the lines, none of them empty, that begin at these places; the other lines stay joined by breaks."""
    start, end, doc = lines_of(raw, offsets)
    stays = np.ones(len(start), dtype=bool)
    # Of lines that begin at one place all but the last are empty.
    stays[np.searchsorted(start, begin, side="right") - 1] = False
    drop = np.zeros(len(raw) + 2, dtype=np.int8)
    gone, kept = np.flatnonzero(~stays), np.flatnonzero(stays)
    # A line goes with the break behind it, which the last line of a text lacks, and the last line that stays loses its own.
    stop = np.minimum(end[gone] + 1, offsets[doc[gone] + 1])
    drop[start[gone]] += 1
    np.subtract.at(drop, stop, 1)
    lost = np.cumsum(drop[:-2], dtype=np.int8) > 0
    final = kept[np.r_[doc[kept][1:] != doc[kept][:-1], True][: len(kept)]]
    lost[end[final][end[final] < offsets[doc[final] + 1]]] = True
    at = np.r_[0, np.cumsum(~lost)][offsets].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw[~lost])).cast(pa.string())


def _without(text: pa.Array, ids: pa.Array, roots: pa.Array, keep: pa.Array, again: pa.Array) -> pa.Array:
    """(text, removed lines): lines of known groups go, but for the first of each group that is kept here.

    Texts whose known lines all stay, once and of different groups, are left as they are."""
    kind = pa.struct([("text", pa.string()), ("removed", pa.int64())])
    known, root, stays, twice = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, roots, keep, again))
    many = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(text)), many)
    order = np.lexsort((root, row))
    met = order[1:][(row[order][1:] == row[order][:-1]) & (root[order][1:] == root[order][:-1])]
    less = np.zeros(len(text), dtype=bool)
    less[row[~stays.astype(bool) | twice.astype(bool)]] = less[row[met]] = True
    less &= text.is_valid().to_numpy(zero_copy_only=False)
    rows, removed = np.flatnonzero(less), np.zeros(len(text), dtype=np.int64)
    name = lambda row, line: tx.mix(line.view(np.uint64) ^ tx.mix(row.astype(np.uint64) + tx.BASE))
    named = name(row, known)
    order = np.argsort(named)
    named, root, stays = named[order], root[order], stays[order].astype(bool)
    parts = [pa.array([], type=pa.string())]
    for first, raw, offsets in tx.slices(text.take(pa.array(rows)), PART):
        begin, _, doc, key, *_ = worded_lines(raw, offsets)
        mine = name(rows[first + doc], key)
        at = np.minimum(np.searchsorted(named, mine), len(named) - 1)
        found = named[at] == mine
        group, gone = np.where(found, root[at], key.view(np.int64)), found & ~stays[at]
        order = np.lexsort((group, doc))
        gone[order[1:][(doc[order][1:] == doc[order][:-1]) & (group[order][1:] == group[order][:-1])]] = True
        parts.append(_cut(raw, offsets, begin[gone]))
        removed[rows[first : first + len(offsets) - 1]] = np.bincount(doc[gone], minlength=len(offsets) - 1)
    text = pc.replace_with_mask(text.cast(pa.string()), pa.array(less), pa.concat_arrays(parts))
    return pa.StructArray.from_arrays([text, pa.array(removed)], fields=list(kind))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines, and ``removed_lines``."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    found = F.arrow_udf(_occurrences, "array<struct<id: long, bits: long, usable: int, size: int, again: boolean>>")
    occurrences = materialise(docs.select(order.alias("key"), F.inline(found("text"))), "occurrences")
    told = [*(F.min(c).alias(c) for c in ("bits", "usable", "size")), F.max("again").alias("again")]
    lines = materialise(occurrences.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), *told), "distinct")
    space = Space(near=like_lengths, bodies=lambda ids: _line_texts(docs, ids), judge=Lines, members=_members, many=len(CHOICES))
    roots = connect(lines.select("id", "bits", "usable", "size"), space)

    grouped = lines.join(roots, "id", "left").filter("root IS NOT NULL OR lo < hi OR again")
    grouped = grouped.select("id", F.coalesce("root", "id").alias("root"), "lo")
    keeper = grouped.groupBy("root").agg(F.min("lo").alias("keeper"))
    grouped = materialise(grouped.join(keeper, "root").select("id", "root", "keeper"), "groups")
    told = occurrences.select("key", "id", "again").join(grouped, "id")
    told = told.groupBy(F.col("key").alias("_key")).agg(
        F.collect_list(F.struct("id", "root", (F.col("key") == F.col("keeper")).alias("keep"), "again")).alias("_told")
    )
    rewrite = F.arrow_udf(_without, "text string, removed long")
    whole = docs.select(F.struct("*").alias("_row"), order.alias("_key")).join(told, "_key", "left")
    whole = whole.withColumn("_new", rewrite("_row.text", "_told.id", "_told.root", "_told.keep", "_told.again"))
    columns = [F.col("_new.text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c != "removed_lines"]
    return whole.select(*columns, F.col("_new.removed").alias("removed_lines"))


@query("op1_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier document holds."""
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "removed_lines")
