"""Hashes of spans and sequences."""

import numpy as np
import pytest

from tsforge.llm import chunks, jaccard, quality
from tsforge.llm import text as tx


def thue_morse(n, one, other):
    return [other if bin(i).count("1") % 2 else one for i in range(n)]


def plain(texts):
    raw = "".join(texts).encode()
    size = np.cumsum([0, *(len(t.encode()) for t in texts)])
    return tx.span_hashes(np.frombuffer(raw, dtype=np.uint8), size[:-1], size[1:])


def test_equal_spans_only():
    parts = ["", "a", "b", "ab", "ba", "a" * 7, "a" * 8, "a" * 9, "\x00", "\x00\x00", "x" * 4096, "x" * 4097, "x" * 5000, "x" * 5001]
    got = plain(parts + ["-"] + parts)
    assert len(set(got[: len(parts)].tolist())) == len(parts) and (got[: len(parts)] == got[len(parts) + 1 :]).all()


@pytest.mark.parametrize("n", [256, 1024, 4096, 16384])
def test_complementary_words_differ(n):
    """Polynomials modulo a power of two take these for equal, whatever their base."""
    a, b = plain(["".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))])
    assert a != b


def test_sequences():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    both = np.concatenate([h, h, h[::-1]])
    first, last = np.array([0, 3000, 6000, 0, 5, 3005]), np.array([3000, 6000, 9000, 0, 9, 3009])
    got = tx.sequence_hashes(both, first, last)
    assert got[0] == got[1] != got[2] and got[4] == got[5] != got[3]


def test_operators_tell_them_apart(make):
    words = [" ".join(thue_morse(1024, *pair)) for pair in (("a", "b"), ("b", "a"))]
    letters = ["".join(thue_morse(1024, *pair)) for pair in (("a", "b"), ("b", "a"))]
    rows = [(i, t) for i, t in enumerate(letters)]
    found = jaccard.near_documents(make(rows)).collect()
    assert {r["component_id"] for r in found} == {0, 1}
    same = [(0, "\n".join(letters), "h"), (1, "\n".join(words), "h")]
    got = quality.measure(make(same, "doc_id long, text string, source string")).collect()
    assert [r["n_dup_lines"] for r in got] == [0, 0] and sorted(len(r["lines"]) for r in got) == [2, 2]
    left = chunks.deduplicate(make([(i, t) for i, t in enumerate(words)])).collect()
    assert {r["doc_id"]: r["text"] for r in left}.keys() == {0, 1}
