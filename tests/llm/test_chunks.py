"""Chunk deduplication against a plain version: byte by byte, chunks by their content, no hashes of chunks."""

import random
import re

import numpy as np

from tsforge.llm import chunks


def plain_chunks(text: bytes) -> list[bytes]:
    """The stated rule, a byte at a time."""
    gear = chunks.GEAR.tolist()

    def rolled(i):
        return sum(gear[text[i - age]] << age for age in range(chunks.WINDOW)) & 0xFFFF

    raw = [i + 1 for i in range(chunks.WINDOW - 1, len(text)) if rolled(i) < int(chunks.BELOW)]
    cuts = [c for n, c in enumerate(raw) if not n or c - raw[n - 1] >= chunks.SPACING]
    edges, out = sorted({0, len(text), *cuts}), []
    for a, b in zip(edges, edges[1:]):
        inner = []
        if b - a > chunks.LONGEST:
            h = {c: rolled(c - 1) for c in range(a + chunks.WINDOW, b)}
            near = range(1, chunks.SPACING)
            for c, x in h.items():
                lower = all(h.get(c - k, 1 << 16) > x and h.get(c + k, 1 << 16) >= x for k in near)
                if x < int(chunks.LOOSELY) and lower:
                    inner.append(c)
        marks = [a, *inner, b]
        out += [text[x:y] for x, y in zip(marks, marks[1:])]
    return out


def plain_deduplicate(rows: list[tuple[int, str]]) -> dict[int, tuple[str, int]]:
    """Every chunk stays where it is met first, by ascending id; runs of others of 16 words or more go."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = text.encode()
        own, at, flags = set(), 0, []
        for chunk in plain_chunks(data):
            flags.append((at, at + len(chunk), chunk in seen or chunk in own))
            own.add(chunk)
            at += len(chunk)
        seen |= own
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        left, removed, n = data, 0, 0
        gone = []
        while n < len(flags):
            m = n
            while m < len(flags) and flags[m][2] == flags[n][2]:
                m += 1
            if flags[n][2]:
                begin, end = flags[n][0], flags[m - 1][1]
                inside = [w for w in words if w[0] >= begin and w[1] <= end]
                if len(inside) >= chunks.MIN_WORDS:
                    after = [w[0] for w in words if w[0] > inside[-1][0]]
                    gone.append((inside[0][0], after[0] if after else inside[-1][1]))
                    removed += len(inside)
            n = m
        for begin, end in reversed(gone):
            left = left[:begin] + left[end:]
        out[key] = left.decode(), removed
    return out


def texts():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(rng.randint(12, 70)) for _ in range(12)]
    out = []
    for _ in range(50):
        parts = [say(rng.randint(3, 50))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), say(rng.randint(0, 30))]
        out.append(rng.choice(" \n").join(parts))
    for unit in ("a", "la ", "ab cd ", "x y z w ", "no boundary here ", "0123456789abcdef "):
        out += [unit * 700, say(9) + " " + unit * 900, unit * 300 + "inserted " + unit * 500]
    return out + ["", " ", "one", out[0], out[0]]


def test_equal_to_the_plain_version(make):
    rows = list(enumerate(texts()))
    random.Random(3).shuffle(rows)
    want = plain_deduplicate(rows)
    got = {r["doc_id"]: (r["text"], r["removed_words"]) for r in chunks.deduplicate(make(rows)).collect()}
    assert got == want
    assert sum(n > 0 for _, n in want.values()) > 20


def test_chunks_equal_the_plain_rule():
    for text in texts():
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            continue
        begin, end, _ = chunks.chunks(raw, np.array([0, len(raw)]))
        assert [raw[a:b].tobytes() for a, b in zip(begin, end)] == plain_chunks(raw.tobytes()), text[:30]


def test_an_insertion_moves_only_near_chunks_of_text_without_boundaries():
    """Units whose bytes never end a chunk by the first mask: long chunks, cut by the second one."""
    rng, seen = random.Random(8), 0
    for _ in range(300):
        unit = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(8, 14)))
        text = (unit * 3000)[:20_000].encode()
        raw = np.frombuffer(text, np.uint8)
        hashes = chunks.gear(raw)[chunks.WINDOW :]
        if (hashes < chunks.BELOW).any() or not (hashes < chunks.LOOSELY).any():
            continue
        seen += 1
        moved = text[:501] + b"#!" + text[501:]
        once = plain_chunks(text)
        before, after = set(once), plain_chunks(moved)
        assert len(once) > 100 and sum(c not in before for c in after) <= 12
    assert seen > 20


def test_repeated_ids_are_one_document(make):
    text = " ".join(f"word{k} of{k * k}" for k in range(60))
    out = chunks.deduplicate(make([(1, text), (1, text), (2, text), (None, None), (None, "")])).collect()
    kept = sorted((r["doc_id"], r["removed_words"]) for r in out if r["doc_id"] is not None)
    assert kept[:2] == [(1, 0), (1, 0)] and kept[2][1] > 90
