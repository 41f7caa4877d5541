"""Source divergence against sums over all kept terms with unbounded integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tsforge.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top=10):
    by, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(FOLD))
        by[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        groups = {s: c for (x, s), c in by.items() if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)
        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            single = [(-f(p[s][t], q[t]), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(single)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def run(make, rows, min_docs=10):
    docs = make([(*r, 1, 2, "x") for r in rows], "text string, lang string, source string, n int, p int, term string")
    return sorted(tuple(r) for r in divergence.audit(docs, min_docs).collect())


def rows_of(corpus, sources=7):
    rng = random.Random(5)
    words = ["".join(rng.choice("abé漢Z") for _ in range(rng.randint(1, 3))) for _ in range(80)]
    rows = [(t, ("en", "fr", None, "")[i % 4], f"s{i % sources}" if i % 9 else None) for i, t in corpus]
    for i in range(150):
        text = " 1,2 ".join(rng.choices(words, k=rng.randint(1, 30)))
        rows.append((text, ("en", "fr")[i % 2], f"s{rng.randrange(sources)}"))
    return rows + [(None, "de", "only"), ("", "es", "a"), ("!!", "es", "b"), (None, "fr", "silent")]


@pytest.mark.parametrize("peers, entries", [(1024, 1 << 20), (3, 50)])
def test_against_plain(make, corpus, monkeypatch, peers, entries):
    """One block, and several blocks of terms and of peers."""
    monkeypatch.setattr(divergence, "PEERS", peers)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "SLICE", 3000)
    monkeypatch.setattr(divergence, "HELD", 40)
    rows = rows_of(corpus)
    for min_docs in (2, 10):
        want = plain(rows, min_docs)
        assert {r[2] for r in want} == {"pair", "term"} and run(make, rows, min_docs) == want


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("", "en", "a")], [(" \n", "en", "a")], [("one two three", "en", "a")]])
def test_small_tables(make, rows):
    for min_docs in (1, 10):
        assert run(make, rows, min_docs) == plain(rows, min_docs)


def test_shares_are_exact(spark):
    cases = [(0, 0, 0), (0, 5, 3), (7, 11, 2), (2**47 - 5, 2**47 - 3, 1), (123456789012, 98765432109876, 54321), (1, 2**47, 9)]
    got = spark.createDataFrame(cases, "n long, total long, kept long").select("*", divergence.share("n", "total", "kept").alias("p"))
    for r in got.collect():
        whole = r.total + 2 * r.kept
        assert r.p == (1 + 10**9 * (r.n + 2) // whole if whole else 1)
