"""Ranked search against plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tsforge.llm import ranked

TERM = re.compile(ranked.PATTERN)
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(FOLD)))
        scores = []
        for (i, c), size in zip(counts, sizes):
            m = 25 + (75 * size * n) // length if length else 0
            score = sum(
                k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, k in asked.items() if c[t]
            )
            scores.append((-score, i is None, i or 0, i))
        best = sorted((s for s in scores if s[0] < 0), key=lambda s: s[:3])[:top]
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(best)]
    return sorted(out, key=repr)


def run(make, docs, items, extra=False):
    if extra:
        d = make([(*r, 1, 2, "x") for r in docs], "doc_id long, text string, item_id int, block int, term string")
        b = make([(*r, 1, 2, "x") for r in items], "item_id long, text string, doc_id int, score int, bundle string")
    else:
        d, b = make(docs), make(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.search(d, b).collect()), key=repr)


def test_against_plain(make, corpus, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 4000)
    monkeypatch.setattr(ranked, "BUNDLE", 4)
    texts = [t for _, t in corpus if t]
    items = [(i, t[: 40 + 60 * (i % 5)]) for i, t in enumerate(texts[:14])]
    items += [(100, None), (101, ""), (102, "!! ??"), (103, "nobodysaysthis"), (104, "one One ONE two"), (104, "one One ONE two")]
    docs = [*corpus, (3, "one two"), (3, "one two"), (None, "one two three four five")]
    want = plain(docs, items)
    assert len(want) > 60 and run(make, docs, items, extra=True) == want


def test_bitmap_only_saves_work(make, corpus, monkeypatch):
    items = [(i, t[:200]) for i, t in enumerate(t for _, t in corpus[:20] if t)]
    want = run(make, corpus, items)
    monkeypatch.setattr(ranked, "BITS", 32_768)
    monkeypatch.setattr(ranked, "_place", lambda names: np.arange(len(names)) % 7)
    assert run(make, corpus, items) == want == plain(corpus, items)


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "")], [(1, " \n")], [(1, "one two three")]])
@pytest.mark.parametrize("items", [[], [(7, "two One 2"), (8, None)]])
def test_small_tables(make, docs, items):
    assert run(make, docs, items) == plain(docs, items)
