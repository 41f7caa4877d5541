"""Line frequency and base rules against a plain version."""

import re
from collections import Counter, defaultdict

import pytest

from tsforge.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_docs, max_loss):
    held = defaultdict(set)
    norm = lambda line: " ".join(WORD.findall(line.translate(FOLD)))
    for i, text, source in rows:
        for line in (text or "").split("\n"):
            if norm(line) and i is not None:
                held[source, norm(line)].add(i)
    out = []
    for i, text, source in rows:
        text = text or ""
        w = WORD.findall(text)
        used = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lost = sum(len(WORD.findall(x)) for x in used if len(held[source, norm(x)]) > max_docs)
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        out.append(
            (i, len(w), sum(map(len, w)), symbols, len(used) - len(set(used)), len(again), lost, failed,
             not failed and not 100 * lost > max_loss * len(w))
        )
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept"]


def test_against_plain(make, corpus, monkeypatch):
    monkeypatch.setattr(quality.tx, "SLICE", 3000)
    rows = [(i, t, ("a", "b", None)[i % 3]) for i, t in corpus]
    rows += [(1, "x y z " * 9, "a"), (1, "x y z " * 9, "a"), (None, "no id # | $ words here of some kind ok yes", "b")]
    docs = make([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, host long, line long")
    for max_docs, max_loss in ((2, 30), (20, 50)):
        got = quality.verdicts(quality.measure(docs), max_docs, max_loss).select(NAMES).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain(rows, max_docs, max_loss)


def test_common_lines_deplete(make):
    rows = [(i, f"Common line that all of them have\nown {i} " + " ".join(f"w{i}{k}" for k in range(n)), "h")
            for i, n in enumerate([3] * 5 + [40] * 5)]
    got = quality.verdicts(quality.measure(make(rows, "doc_id long, text string, source string")), 9, 50).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {i: i >= 5 for i in range(10)}


def test_empty(make):
    assert quality.verdicts(quality.measure(make([], "doc_id long, text string, source string"))).count() == 0


@pytest.mark.parametrize("text", [None, "", " ", "one two three", "a\n\nb"])
def test_batches_of_short_texts(make, text):
    rows = [(1, text, "a")]
    got = quality.verdicts(quality.measure(make(rows, "doc_id long, text string, source string"))).select(NAMES).collect()
    assert [tuple(r) for r in got] == plain(rows, 20, 50)
