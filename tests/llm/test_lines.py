"""Line groups against an edit distance of all pairs that shares no code with the operator."""

import random
import re

import duckdb
import numpy as np
import pytest

from tsforge.llm import crowds, lines, regions
from tsforge.llm import text as tx

GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain(line):
    return GAP.sub(b" ", line.encode().lower()).strip()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    longer = max(len(a), len(b))
    return abs(len(a) - len(b)) <= 0.2 * longer and levenshtein(a, b) <= 0.2 * longer


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(400):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 1)))
        b, most = bytes(b), rng.randint(0, 10)
        assert lines.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


@pytest.fixture(scope="module")
def originals():
    """Lines of the test corpus by number of words: classes under 10, 20, 30, 60 and above."""
    sql = "SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM '/root/testdata/sf0.001/documents.parquet')"
    found = sorted(r[0] for r in duckdb.sql(sql).fetchall())
    random.Random(1).shuffle(found)
    by = {10: [], 20: [], 30: [], 60: [], 10**9: []}
    for line in found:
        n = len(plain(line).split())
        if len(plain(line)) >= 24 and n >= 4:
            by[next(k for k in by if n < k)].append(line)
    return {k: v[:60] for k, v in by.items()}


def edited(rng, line, words, kind):
    w = line.split()
    at = rng.randrange(len(w))
    if kind == "letter":
        long = max(range(len(w)), key=lambda k: (len(w[k]) > 3, rng.random()))
        k = rng.randrange(len(w[long]))
        w[long] = w[long][:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[long][k + 1 :]
    elif kind == "replaced":
        w[at] = rng.choice(words)
    else:
        w.insert(at, rng.choice(words))
    return " ".join(w)


@pytest.mark.parametrize("kind", ["letter", "replaced", "inserted"])
def test_recall_of_one_edit_by_length(make, originals, kind):
    """Of all lines with an edit similarity of 0.8 to their original, by a plain distance, nine in ten go.

    Below ten words eight in ten: there an edit may leave too few bytes in the blocks that it does not touch.
    """
    rng = random.Random(6)
    words = [w for group in originals.values() for line in group for w in line.split() if w.isalpha()]
    rows, wanted = [], {most: [] for most in originals}
    for place, (most, group) in enumerate(originals.items()):
        for k, line in enumerate(group, 100 * place):
            other = edited(rng, line, words, kind)
            rows += [(k, line), (1000 + k, other)]
            if similar(plain(line), plain(other)):
                wanted[most].append(1000 + k)
    gone = {r["doc_id"] for r in lines.deduplicate(make(rows)).collect() if r["removed_lines"]}
    for most, ids in wanted.items():
        least = 0.8 if most == 10 else 0.9
        assert ids and sum(k in gone for k in ids) >= least * len(ids), (most, kind, len(ids), sum(k in gone for k in ids))


def test_nothing_else_goes(make, originals):
    """All pairs of a small corpus: a line that goes is linked, through similar lines, to one that stays."""
    rng = random.Random(3)
    group = [line for g in originals.values() for line in g[:12]]
    words = [w for line in group for w in line.split() if w.isalpha()]
    rows = [(k, line) for k, line in enumerate(group)]
    rows += [(100 + k, edited(rng, line, words, "replaced")) for k, line in enumerate(group)]
    out = {r["doc_id"]: r for r in lines.deduplicate(make(rows)).collect()}
    texts = dict(rows)
    gone = {k for k, r in out.items() if r["removed_lines"]}
    for k in gone:
        assert any(similar(plain(texts[k]), plain(texts[j])) for j in texts if j != k)
        assert out[k]["text"] == ""
    assert all(out[k]["text"] == texts[k] for k in out if k not in gone)
    # Everything that is not linked to a line of an earlier row stays.
    for k in texts:
        if not any(similar(plain(texts[k]), plain(texts[j])) for j in texts if j != k):
            assert k not in gone


def test_copies_short_lines_and_clashing_names(make):
    text = "Some line that is long enough\nSome line, that is long enough!\nshort\nshort\n--\n--\n\n"
    rows = [(900, text), (901, "short\nSHORT?\nshirt"), (None, "short"), (None, None), (902, ""), (903, " \n")]
    out = lines.deduplicate(make([(*r, 1, 2) for r in rows], "doc_id long, text string, removed_lines long, _key long"))
    assert out.columns == ["doc_id", "text", "_key", "removed_lines"]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    known = dict(x for x in got if x[0] is not None)
    assert known[902] == "" and known[903] == " \n" and (None, None) in got
    # One "short" stays over the corpus, "shirt" is below the floor of fuzzy links, lines without words stay.
    left = "\n".join(t for _, t in got if t).split("\n")
    assert sum(line == "short" for line in left) + sum(line == "SHORT?" for line in left) == 1
    assert "shirt" in left and left.count("--") == 2 and "Some line that is long enough" in left
    assert "Some line, that is long enough!" not in left
    assert lines.deduplicate(make([])).count() == 0


def test_a_crowd_of_copies_leaves_one(make):
    """One base line with one word changed in each of 300 copies: one group, one line stays."""
    words = [f"{a}{b}ward" for a in "bcdfghklmnprst" for b in "aeiou"]
    rng = random.Random(9)
    base = [rng.choice(words) for _ in range(20)]
    rows = [(k, " ".join(base[: k % 20] + [rng.choice(words) + str(k)] + base[k % 20 + 1 :])) for k in range(300)]
    out = {r["doc_id"]: r["removed_lines"] for r in lines.deduplicate(make(rows)).collect()}
    assert sum(out.values()) == 299 and out[0] == 0


def test_an_edit_of_a_word_leaves_a_key(originals):
    rng = random.Random(8)
    for line in [x for g in originals.values() for x in g]:
        w = plain(line).split()
        other = list(w)
        other[rng.randrange(len(w))] = b"zebra"
        data = [b" ".join(w), b" ".join(other)]
        raw = np.frombuffer(b"\n".join(data), np.uint8)
        _, _, _, _, n, first, _, found = lines.worded_lines(raw, np.array([0, len(raw)]))
        bits, usable = lines.simhashes(raw, found, first, n)
        meets = [k for k, m in enumerate(m % (1 << 64) for m in lines.masks()) if int(bits[0]) & m == int(bits[1]) & m]
        assert meets and (len(w) < 10 or any(int(usable[0]) >> k & 1 for k in meets))


def test_lines_do_not_depend_on_slices(corpus, monkeypatch):
    import pyarrow as pa

    column = pa.array([t for _, t in corpus], type=pa.string())
    whole = lines._occurrences(column)
    monkeypatch.setattr(tx, "SLICE", 5000)
    monkeypatch.setattr(lines, "VOTES", 50)
    assert lines._occurrences(column).equals(whole)


def test_a_pair_of_lines_is_compared_in_one_region_only():
    """Two lines with the same SimHash meet in ten regions; the judge lets them by in that of their first choice."""
    line = b"the quick brown fox jumps over the lazy dog"
    told = np.array([12345, (1 << len(lines.CHOICES)) - 1], dtype=np.int64).tobytes()
    choices = np.arange(len(lines.CHOICES))
    body = np.array([told + line, told + line + b"s"] * len(choices) + [None], dtype=object)[:-1]
    judge = lines.Lines(body, np.repeat(choices << lines.CHOICE_AT, 2))
    assert judge.may(2 * choices, 2 * choices + 1).tolist() == [True] + [False] * (len(choices) - 1)
    assert judge.links(0, np.array([1])).all()


def test_a_bound_tells_crowds_of_unlike_lines_apart(monkeypatch):
    """Few of the pairs of a crowd of unlike lines take an edit distance, and the groups are those of all pairs."""
    from tsforge.llm import regions

    rng = random.Random(12)
    syllables = "the and ing ion ent ber ver sch lich keit".split()
    crowd = ["".join(rng.choice(syllables) + rng.choice(("", " ")) for _ in range(rng.randint(40, 50))).encode() for _ in range(120)]
    for k in range(0, 40, 2):
        at = rng.randrange(len(crowd[k]))
        crowd[k + 1] = crowd[k][:at] + b"x" * rng.randint(0, 60) + crowd[k][at + rng.randint(0, 9) :]
    calls, exact = [], lines.edit_distance
    monkeypatch.setattr(lines, "edit_distance", lambda *x: calls.append(x) or exact(*x))
    for many in (20, 120):
        rows = crowd[:many]
        told = np.array([0, 1], dtype=np.int64).tobytes()
        body = np.array([told + x for x in rows] + [None], dtype=object)[:-1]
        judge = lines.Lines(body, np.zeros(many, dtype=np.int64))
        size = np.fromiter(map(len, rows), dtype=np.int64)
        calls.clear()
        label = regions.settle(np.array([many]), size, np.zeros(many, dtype=np.int64), lines.like_lengths, judge)
        assert len(calls) < many * (many - 1) // 20
        root = list(range(many))
        for i in range(many):
            for j in range(i):
                if similar_fast(exact, rows[i], rows[j]):
                    root = [root[i] if r == root[j] else r for r in root]
        assert len(set(root)) < many
        pairs = lambda x: {(i, j) for i in range(many) for j in range(i) if x[i] == x[j]}
        assert pairs(root) == pairs(label.tolist())


def similar_fast(distance, a, b):
    return abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and distance(a, b, 1 << 30) <= 0.2 * max(len(a), len(b))


def test_the_bound_of_beginnings_is_below_the_distance():
    rng = random.Random(5)
    word = lambda n: bytes(rng.choice(b"abc 12\xc3\xa4\x9f") for _ in range(n))
    for words in (1, 2, 3):
        pairs = []
        for _ in range(40):
            a = word(rng.randint(64 * (words - 1) + 1, 64 * words + 60))
            b = bytearray(a if rng.random() < 0.7 else word(rng.randint(1, len(a))))
            for _ in range(rng.randint(0, 30)):
                at = rng.randint(0, len(b))
                b[at : at + rng.randint(0, 2)] = word(rng.randint(0, 2))
            b = bytes(b[: len(a)]) or b"a"
            pairs.append((a, b))
        size = np.array([[len(a), len(b)] for a, b in pairs]).ravel()
        raw = np.frombuffer(b"".join(x for p in pairs for x in p), dtype=np.uint8)
        start = np.cumsum(size) - size
        most = (0.2 * size[::2]).astype(np.int64)
        got = lines._prefix_bound(raw, start[::2], size[::2], start[1::2], size[1::2], most, words)
        for (a, b), bound in zip(pairs, got.tolist()):
            d = levenshtein(a, b)
            assert bound <= d or bound > int(0.2 * len(a)) < d
            if len(a) <= 64 * words and len(set(a + b) & set(b"\xc3\xa4\x9f")) == 0 and d <= int(0.2 * len(a)):
                assert bound == d


def test_pairs_that_surely_link_take_no_edit_distance(monkeypatch):
    """Lines with a few edits link by equal stretches; what is called alike is alike, at any number of edits."""
    rng = random.Random(15)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    found = []
    for edits in (0, 1, 3, 8, 25):
        for _ in range(60):
            a = word(rng.randint(60, 160))
            b = bytearray(a)
            for _ in range(edits):
                at = rng.randint(0, len(b))
                b[at : at + rng.randint(0, 3)] = word(rng.randint(0, 3))
            b, most = bytes(b), rng.randint(0, 32)
            d = levenshtein(a, b)
            found.append((edits, most >= 3 * edits + lines.ANCHOR, lines.surely_alike(a, b, most)))
            assert d <= most or not found[-1][2]
    assert all(alike for edits, room, alike in found if edits <= 1 and room)
    assert sum(alike for edits, room, alike in found if edits == 3 and room) >= 0.8 * sum(room for edits, room, _ in found if edits == 3)
    calls, exact = [], lines.edit_distance
    monkeypatch.setattr(lines, "edit_distance", lambda *x: calls.append(x) or exact(*x))
    base = b" ".join(word(9).replace(b" ", b"x") for _ in range(60))
    told = np.array([0, 1], dtype=np.int64).tobytes()
    rows = [base[:at] + b"zebra" + base[at + 5 :] for at in range(0, 500, 25)]
    judge = lines.Lines(np.array([told + x for x in rows] + [None], dtype=object)[:-1], np.zeros(len(rows), dtype=np.int64))
    a, b = np.triu_indices(len(rows), 1)
    assert judge.may(a, b).all() and judge.links(0, np.arange(1, len(rows))).all() and not calls


def test_votes_of_long_and_short_lines_together():
    """Counts of bits over ranges of any length, beside a sum of the unpacked bits."""
    bits = tx.mix(np.arange(3000, dtype=np.uint64))
    for begin in ([0], [0, 1, 4, 300], [0, 255, 510, 511, 1400], list(range(0, 3000, 7))):
        plain = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        wanted = np.stack([part.sum(axis=0) for part in np.split(plain, begin[1:])])
        assert (lines._ones(bits, np.array(begin)) == wanted).all()


def test_the_bound_of_blocks_is_below_a_distance_within_the_limit():
    """Lines with edits anywhere, and unlike ones; only pairs that are apart may be told apart."""
    rng = random.Random(21)
    word = lambda n: bytes(rng.choice(b"abc 12\xc3\xa4\x9f") for _ in range(n))
    pairs = []
    for k in range(60):
        a = word(rng.randint(64, 420))
        b = bytearray(a if k % 4 else word(len(a) - rng.randint(0, 10)))
        for _ in range(rng.randint(0, len(a) // 8)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 3)] = word(rng.randint(0, 3))
        pairs.append((a, bytes(b[: len(a)])))
        if k % 4 == 1:
            # A whole stretch is moved out of the way, to the largest shift within the limit.
            pairs.append((a, a[: len(a) // 3] + a[len(a) // 3 + len(a) // 5 :]))
    size = np.array([[len(a), len(b)] for a, b in pairs]).ravel()
    raw = np.frombuffer(b"".join(x for p in pairs for x in p), dtype=np.uint8)
    start, most = np.cumsum(size) - size, (0.2 * size[::2]).astype(np.int64)
    got = lines._block_bound(raw, start[::2], size[::2], start[1::2], size[1::2], most)
    exact = [levenshtein(a, b) for a, b in pairs]
    near = [(bound, d) for bound, d, limit in zip(got.tolist(), exact, most.tolist()) if d <= limit]
    assert len(near) > 20 and all(bound <= d for bound, d in near)
    assert (got > most).sum() >= 10


def test_long_unlike_lines_take_no_edit_distance(monkeypatch):
    rng = random.Random(22)
    syllables = "the and ing ion ent ber ver sch lich keit".split()
    rows = ["".join(rng.choice(syllables) + rng.choice(("", " ")) for _ in range(2600)).encode() for _ in range(12)]
    told = np.array([0, 1], dtype=np.int64).tobytes()
    judge = lines.Lines(np.array([told + x for x in rows] + [None], dtype=object)[:-1], np.zeros(len(rows), dtype=np.int64))
    a, b = np.triu_indices(len(rows), 1)
    assert min(map(len, rows)) > 6400 and not judge.may(a, b).any()


def test_edit_distance_in_a_band():
    """Shifts up to the edge of the band, and limits on both sides of the distance."""
    rng = random.Random(23)
    for _ in range(60):
        a = bytes(rng.choice(b"abc ") for _ in range(rng.randint(150, 330)))
        b, cut = bytearray(a), rng.randint(0, 40)
        at, to = rng.randrange(len(a) - 40), rng.randrange(len(a) - 40)
        moved = bytes(b[at : at + cut])
        del b[at : at + cut]
        b[to:to] = moved + bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 12)))
        b, d = bytes(b), levenshtein(a, bytes(b))
        for most in (d - 1, d, d + 1, 2 * d + 5, 1 << 30):
            if most >= 0:
                assert lines.edit_distance(a, b, most) == min(d, most + 1)
                assert lines.edit_distance(b, a, most) == min(d, most + 1)


def test_texts_whose_lines_all_stay_are_not_read_again(monkeypatch):
    """Lines go at the beginning, the middle and the end of a text; texts that lose none are left as they are."""
    import pyarrow as pa

    rng = random.Random(24)
    words, texts = ["first line", "Zweite Zeile ä", "third", "", " ", "!!"], []
    for _ in range(300):
        texts.append(None if rng.random() < 0.1 else "\n".join(rng.choice(words) for _ in range(rng.randint(0, 6))))
    known = lines._occurrences(pa.array(texts, type=pa.string())).to_pylist()
    goes = {known[k][0]["id"] for k in range(300) if texts[k] == "third"} or {None}
    told = [[(x["id"], x["id"], x["id"] not in goes, x["again"]) for x in row if x["again"] or x["id"] in goes] for row in known]
    kinds = pa.int64(), pa.int64(), pa.bool_(), pa.bool_()
    columns = [pa.array([[x[c] for x in row] or None for row in told], type=pa.list_(kind)) for c, kind in enumerate(kinds)]
    read, whole = [], lines.worded_lines
    monkeypatch.setattr(lines, "worded_lines", lambda raw, at, *x: read.append(len(at) - 1) or whole(raw, at, *x))
    got = lines._without(pa.array(texts, type=pa.string()), *columns).to_pylist()
    assert sum(read) == sum(r["removed"] > 0 for r in got) < 250
    for text, r in zip(texts, got):
        met, left = set(), []
        for line in (text or "").split("\n"):
            if not plain(line) or (plain(line) not in met and plain(line) != b"third"):
                left.append(line)
            met.add(plain(line))
        assert r["text"] == (None if text is None else "\n".join(left))
        assert r["removed"] == len((text or "").split("\n")) - len(left)


def _syllables(rng, n):
    """A line of about n bytes of words of few syllables, so that lines share most runs of bytes."""
    made = ""
    while len(made) < n:
        made += "".join(rng.choice("ab en der ing tion st ou ch re".split()) for _ in range(rng.randint(1, 3))) + " "
    return made.strip().encode()


def _crowd(rng, sizes):
    """(raw, start, size, region) of lines ordered by region and size, a third of them edits of others."""
    found = []
    for region, many in enumerate(sizes):
        own = [_syllables(rng, rng.choice([18, 40, 90, 130, 300])) for _ in range(many)]
        for k in range(many // 3):
            line = bytearray(rng.choice(own))
            for _ in range(rng.randint(0, len(line) // 4)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice([b"", b"x", b"e", b" "])
            own[k] = bytes(line)
        found += [(region, len(x), x) for x in own]
    found.sort(key=lambda x: x[:2])
    size = np.array([n for _, n, _ in found])
    raw = np.frombuffer(b"".join(x for _, _, x in found), dtype=np.uint8)
    return raw, np.cumsum(size) - size, size, np.array([r for r, _, _ in found]), [x for _, _, x in found]


@pytest.mark.parametrize("grams", [((768, 3, 11),), ((768, 4, 13),), ((60, 3, 4), (100, 2, 9))])
def test_a_sift_keeps_every_pair_within_the_limit(monkeypatch, grams):
    rng = random.Random(41)
    monkeypatch.setattr(crowds, "GRAMS", grams)
    monkeypatch.setattr(crowds, "JOBS", 50)
    monkeypatch.setattr(crowds, "HELD", 1 << 18)
    raw, start, size, region, found = _crowd(rng, [90, 1, 2, 40])
    parts = list(crowds.sift(raw, start, size, region, 0.2))
    got = list(zip(np.concatenate([a for a, _ in parts]).tolist(), np.concatenate([b for _, b in parts]).tolist()))
    like = {
        (i, j)
        for i in range(len(found))
        for j in range(i)
        if region[i] == region[j] and lines.edit_distance(found[j], found[i], 999) <= int(0.2 * size[i])
    }
    assert len(like) > 20 and len(got) == len(set(got)) and like <= set(got)
    assert all(j < i and region[i] == region[j] and size[i] - size[j] <= int(0.2 * size[i]) for i, j in got)


def test_a_crowd_of_unlike_lines_is_sifted(monkeypatch):
    """Few pairs of a crowd come to a comparison of their own; what links is what links pair by pair."""
    rng = random.Random(43)
    raw, start, size, region, found = _crowd(rng, [700])
    pairs = []
    monkeypatch.setattr(lines.Lines, "may", lambda self, a, b, may=lines.Lines.may: pairs.append(len(a)) or may(self, a, b))
    told = np.array([0, 1], dtype=np.int64).tobytes()
    got = {}
    for crowd in (lines.CROWD, 10**9):
        order = np.random.default_rng(5).permutation(len(found))
        judge = lines.Lines(np.array([told + found[k] for k in order], dtype=object), np.zeros(len(found), dtype=np.int64))
        judge.crowd = crowd
        pairs.append(0)
        got[crowd] = regions.settle(np.array([len(found)]), size[order], np.zeros(len(found), np.int64), lines.like_lengths, judge), sum(pairs)
        pairs.clear()
    (sifted, few), (plain_label, many) = got.values()
    as_sets = [{tuple(np.flatnonzero(label == k)) for k in set(label.tolist())} for label in (sifted, plain_label)]
    assert as_sets[0] == as_sets[1] and 1 < len(as_sets[0]) < len(found)
    assert many > 40_000 and few < many // 10


def test_a_crowd_of_copies_beside_other_lines_takes_few_comparisons(monkeypatch):
    rng = random.Random(44)
    line = _syllables(rng, 200)
    found = [_syllables(rng, 60)] + [line[:k] + b"x" + line[k:] for k in range(150)]
    calls = []
    monkeypatch.setattr(lines, "surely_alike", lambda a, b, most, alike=lines.surely_alike: calls.append(1) or alike(a, b, most))
    told = np.array([0, 1], dtype=np.int64).tobytes()
    judge = lines.Lines(np.array([told + x for x in found], dtype=object), np.zeros(len(found), dtype=np.int64))
    size = np.array([len(x) for x in found])
    label = regions.settle(np.array([len(found)]), size, np.zeros(len(found), np.int64), lines.like_lengths, judge)
    assert len(set(label.tolist())) == 2 and len(calls) < 4 * len(found)
