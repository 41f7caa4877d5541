"""Jaccard join, line groups, chunks, vectors and components against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsforge.llm import chunks, jaccard, regions, vectors
from tsforge.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
             if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    return sets, least_reachable(ids, links)


@pytest.fixture(scope="module")
def family():
    """A crowd of near copies around a few centres, with chains and strangers that share a passage."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for centre in range(2):
        base = [rng.choice(vocabulary) for _ in range(100)]
        for k in range(60):
            w = list(base)
            for _ in range(k % 7):
                w[rng.randrange(100)] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    passage = [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(40):
        rows.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(60)]))
    w = [rng.choice(vocabulary) for _ in range(60)]
    for k in range(30):
        w[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [16, 2048])
def test_jaccard_components(make, corpus, family, monkeypatch, block):
    monkeypatch.setattr(regions, "BLOCK", block)
    rows = corpus + [(i + 10_000, t) for i, t in family]
    sets, expected = plain_components(rows)
    got = {r["doc_id"]: r for r in jaccard.near_documents(make(rows)).collect()}
    assert len(got) == len(rows)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_one_document_of_each_group_stays(make, corpus):
    rows = [(i, t, "k", i) for i, t in corpus] + [(None, "a b c d e f g", "k", 0)] * 2 + [(500, "same row here", "k", 1)] * 2
    out = jaccard.one_of_each_group(make(rows, "doc_id long, text string, _set string, id long")).collect()
    _, expected = plain_components(corpus + [(500, "same row here")])
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == sorted(i for i, c in expected.items() if i == c)
    assert sum(r["doc_id"] is None for r in out) == 1
    assert jaccard.one_of_each_group(make([])).count() == 0


def test_limit_is_exact(make):
    w = [f"w{k}" for k in range(200)]
    base = w[:19]  # 15 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base + ["x", "y", "z", "q", "r"])), (3, " ".join(base + ["x", "y", "z", "q", "r", "s"]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_documents(make(rows)).collect()}
    # 15 of 20 shingles is exactly 0.75; 15 of 21 is not, but 2 and 3 link.
    assert got == {1: 1, 2: 1, 3: 1}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_documents(make(rows[::2])).collect()} == {1: 1, 3: 3}


def test_components_of_chains_stars_and_loops(spark, make):
    rng = random.Random(2)
    name = [rng.getrandbits(62) for _ in range(400)]
    links = [(k, k + 1) for k in range(150)] + [(200, k) for k in range(201, 300)] + [(300, 300), (310, 311), (311, 310)]
    got = components(make([(name[a], name[b]) for a, b in links], "a long, b long")).collect()
    at = {n: k for k, n in enumerate(name)}
    expected = least_reachable(range(400), links)
    mine = least_reachable(range(400), [(at[r["id"]], at[r["root"]]) for r in got])
    assert mine == expected and len(got) == len({r["id"] for r in got})
    assert {at[r["id"]] for r in got} == {k for a, b in links if a != b for k in (a, b)}
    assert components(make([], "a long, b long")).count() == 0


def test_chunks_resist_shifts_and_catch_passages(make):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(40)]
    rows = [(2 * k, f"{text(80)} {p} {text(50)}") for k, p in enumerate(passages)]
    rows += [(2 * k + 1, f"{text(33 + k)}\n{p}\n{text(20)}") for k, p in enumerate(passages)]
    clean = [(1000 + k, text(150) + "\nAll rights reserved.\n" + text(5)) for k in range(40)]
    rows += clean + [(None, None), (5000, ""), (5001, "  "), (6000, passages[0] + " " + text(9) + " " + passages[0])]
    docs = make([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, removed_words long, _known long")
    out = {r["doc_id"]: r for r in chunks.deduplicate(docs).collect()}
    before = dict(rows)
    assert len(out) == len(before)
    for k, p in enumerate(passages):
        assert out[2 * k]["text"] == before[2 * k]
        left = out[2 * k + 1]["text"]
        assert p not in left and out[2 * k + 1]["removed_words"] >= chunks.MIN_WORDS
        head, tail = before[2 * k + 1].split(p)
        assert left.startswith(head) and left.endswith(tail.lstrip())
        assert len(left.split()) == len(before[2 * k + 1].split()) - out[2 * k + 1]["removed_words"]
    assert all(out[i]["text"] == t and out[i]["removed_words"] == 0 for i, t in clean)
    assert out[None]["text"] is None and out[5000]["text"] == "" and out[5001]["text"] == "  "
    assert passages[0] not in out[6000]["text"]
    assert chunks.deduplicate(make([])).count() == 0


def test_chunks_do_not_depend_on_slices(corpus):
    texts = [(t or "").encode() for _, t in corpus]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    begin, end, doc = chunks.chunks(raw, offsets)
    for k, t in enumerate(texts):
        own = np.frombuffer(t, np.uint8)
        b, e, _ = chunks.chunks(own, np.array([0, len(own)]))
        assert (b == begin[doc == k] - offsets[k]).all() and (e == end[doc == k] - offsets[k]).all()
        assert (e - b).sum() == len(t)
    total = np.zeros(len(raw), np.uint16)
    for age in range(chunks.WINDOW):
        total[age:] += chunks.GEAR[raw[: len(raw) - age]] << np.uint16(age)
    assert (chunks.gear(raw) == total).all()


def test_vectors(make):
    rng = np.random.default_rng(1)
    points = []
    for size in (1, 2, 3, 60, 200):
        centre = rng.normal(size=16)
        points += [centre + 0.15 * np.linalg.norm(centre) / 4 * rng.normal(size=16) for _ in range(size)]
    points += list(rng.normal(size=(300, 16)))
    points += [points[5]] * 40 + [2 * points[9]]
    rows = [(k, [float(np.float32(x)) for x in p]) for k, p in enumerate(points)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [2.0, 0.1]]
    rows += [(10_000 + k, v) for k, v in enumerate(odd)]
    ddl = "vec_id long, embedding array<float>, label int"
    out = vectors.near_vectors(make([(*r, 1) for r in rows], ddl), block=32, probes=4)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    x = np.array([v for _, v in rows[: len(points)]], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    expected = least_reachable(range(len(points)), [(a, b) for a, b in np.argwhere(links).tolist() if a < b])
    found = sum(got[k]["n_links"] for k in range(len(points)))
    assert all(got[k]["n_links"] <= links[k].sum() for k in range(len(points)))
    assert found >= 0.99 * links.sum()
    same = [got[k]["component_id"] == expected[k] for k in range(len(points))]
    assert np.mean(same) > 0.99
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got.values())
    assert [got[10_000 + k]["n_links"] for k in range(8)] == [0] * 6 + [1, 1]
    assert [got[10_000 + k]["component_id"] for k in range(8)] == [*range(10_000, 10_006), 10_006, 10_006]


def test_no_vectors_and_no_ids(make):
    ddl = "vec_id long, embedding array<float>"
    assert vectors.near_vectors(make([], ddl)).count() == 0
    out = vectors.near_vectors(make([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [0.0, 0.0])], ddl)).collect()
    assert sorted(((r["id"], r["n_links"], r["component_id"]) for r in out), key=repr) == [(4, 0, 4), (4, 1, 4), (None, 1, 4)]


def test_regions_are_exhausted(make, monkeypatch):
    """One crowded region of strangers and two families: every linked pair is connected."""
    monkeypatch.setattr(regions, "BLOCK", 11)
    spots = {k: (k if k < 30 else 100 + (k % 2) * 50 + k / 100) for k in range(60)}
    members = make([(1, k, 0) for k in spots], "key long, id long, aux long")

    def compare(pairs):
        place = F.create_map(*[F.lit(x) for k, v in spots.items() for x in (k, float(v))])
        return pairs.withColumn("d", F.abs(place[F.col("a")] - place[F.col("b")]))

    space = regions.Space(near=lambda a, b: np.ones(len(a), bool), compare=compare, limit=0.5)
    got = regions.connect(members, space).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [list(range(30, 60, 2)), list(range(31, 60, 2))]


def test_sketches_never_exclude_a_link():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 40_000, dtype=np.uint64)
    sets = []
    for n in (1, 3, 20, 64, 65, 100, 130, 500, 700, 3000):
        base = rng.choice(pool, n, replace=False)
        sets.append(base)
        for share in (0.02, 0.1, 0.14, 0.3):
            cut = max(0, n - int(n * share))
            sets.append(np.unique(np.r_[base[:cut], rng.choice(pool, int(n * share))]))
    sketch = np.array([jaccard.parity(s) for s in sets] + [None], dtype=object)[:-1]
    aux = np.array([len(s) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    close = jaccard.similar_sizes(aux[a], aux[b])
    a, b = a[close], b[close]
    may = regions.may_link(sketch, aux, a, b, jaccard.within_limit)
    for i, j, m in zip(a, b, may):
        shared = len(np.intersect1d(sets[i], sets[j]))
        assert m or 4 * shared < 3 * (aux[i] + aux[j] - shared)
    assert may.mean() < 0.6


def test_forests_span_what_may_link(monkeypatch):
    """Doubling forests of a region: few edges, edge-disjoint, all pairs in the end."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        m = int(rng.integers(2, 30))
        spot, root = rng.integers(0, 40, m), np.arange(m)
        root[rng.random(m) < 0.4] = 0
        side = rng.integers(0, 2, m) * int(rng.integers(0, 2))
        got = {"id": np.arange(m), "aux": spot, "root": root, "side": side, "home": np.arange(m), "away": np.zeros(m)}
        rules = regions.Rules(lambda a, b: np.abs(a - b) <= 6, None, np.inf)
        both = len(set(side.tolist())) > 1
        wanted = {(a, b) for a in range(m) for b in range(a + 1, m) if abs(spot[a] - spot[b]) <= 6 and root[a] != root[b]
                  and (not both or side[a] != side[b])}
        many, left_out = 1, True
        while left_out:
            edges, left_out = regions.forests(got, rules, many)
            assert len(edges) == len(set(edges)) <= many * (m - 1) and set(edges) <= wanted
            joined = [(int(a), int(b)) for a, b in enumerate(root)]
            assert least_reachable(range(m), joined + edges) == least_reachable(range(m), joined + list(wanted))
            many *= 2
        assert set(edges) == wanted


def test_stars_do_not_depend_on_batches():
    rng = np.random.default_rng(8)
    size = rng.choice([1, 2, 3, 4, 5, 9, 40], 60)
    key = np.repeat(np.arange(60), size)
    ids = np.concatenate([np.sort(rng.choice(1000, n, replace=False)) for n in size])
    again = rng.integers(1, 3, len(key))
    near = lambda a, b: np.abs(a - b) <= 500
    for step in (1, 2, 3, 7, 1000):
        stars, pairs, crowd = regions.Stars(near), set(), []
        k, i = np.repeat(key, again), np.repeat(ids, again)
        for first in range(0, len(k), step):
            p, c = stars.feed(k[first : first + step], i[first : first + step], i[first : first + step])
            pairs |= set(map(tuple, p.tolist()))
            crowd += zip(*(x.tolist() for x in c))
        if not stars.crowded:
            none = np.zeros(0, dtype=np.int64)
            pairs |= set(map(tuple, stars.feed(none, none, none, end=True)[0].tolist()))
        groups = [ids[key == n].tolist() for n in range(60)]
        assert pairs == {(a, b) for g in groups if len(g) <= regions.FEW for k, a in enumerate(g) for b in g[k + 1 :] if b - a <= 500}
        wanted = [(n, b, b, g[0] if b - g[0] <= 500 else b) for n, g in enumerate(groups) if len(g) > regions.FEW for b in g]
        assert sorted(crowd) == wanted


def test_near_copies_give_one_edge_a_member(make, monkeypatch):
    """Items that meet in many regions: one region of the same members, no more edges than its members, all links found."""
    made = []

    class Close:
        step = 1 << 30

        def __init__(self, body, key):
            self.spot = np.array([int(x) for x in body])

        def may(self, a, b):
            return np.ones(len(a), dtype=bool)

        def links(self, i, rest):
            return abs(self.spot[rest] - self.spot[i]) <= 1

    rows = [(key, k, 0) for key in range(30) for k in range(100)] + [(100 + k, k, 0) for k in range(300)]
    bodies = make([(k, str(k if k < 50 else 10 * k).encode()) for k in range(300)], "id long, body binary")
    members = make(rows, "key long, id long, aux long")
    assert regions._shared(members).count() == 100
    monkeypatch.setattr(regions, "components", lambda edges: made.append(edges.count()) or components(edges))
    space = regions.Space(near=lambda a, b: np.ones(len(a), bool), bodies=lambda ids: bodies, judge=Close)
    got = regions.connect(members, space).collect()
    assert made == [49] and sorted(r["id"] for r in got) == list(range(50)) and len({r["root"] for r in got}) == 1


def test_shared_members_do_not_depend_on_batches():
    rng = np.random.default_rng(4)
    size = rng.choice([1, 1, 2, 3, 40], 60)
    key = np.repeat(np.arange(60), size)
    ids = np.concatenate([np.sort(rng.choice(1000, n, replace=False)) for n in size])
    wanted = [(k, i) for k, i in zip(key.tolist(), ids.tolist()) if size[k] > 1]
    sums = {n: int(jaccard.tx.mix(ids[key == n].view(np.uint64) ^ jaccard.tx.BASE).sum().view(np.int64)) for n in range(60)}
    again = rng.integers(1, 3, len(key))
    k, i, none = np.repeat(key, again), np.repeat(ids, again), np.zeros(0, dtype=np.int64)
    for step in (1, 2, 3, 7, 1000):
        shared, rows, marks = regions.Shared(), [], []
        for first in [*range(0, len(k), step), None]:
            part = (k[first : first + step], i[first : first + step]) if first is not None else (none, none)
            r, m = shared.feed(*part, part[1], end=first is None)
            rows += zip(*(x.tolist() for x in r[:2]))
            marks += zip(*(x.tolist() for x in m))
        assert sorted(rows) == wanted
        assert sorted(marks) == [(n, int(size[n]), sums[n]) for n in range(60) if size[n] > 1]


def test_settled_rows_are_those_that_links_reach(monkeypatch):
    rng = np.random.default_rng(6)

    class Close:
        def __init__(self, spot, step):
            self.spot, self.step = spot, step

        def may(self, a, b):
            return abs(self.spot[a] - self.spot[b]) <= 3

        def links(self, i, rest):
            return abs(self.spot[rest] - self.spot[i]) <= 2

    for step in (1, 5, 1 << 30):
        for _ in range(20):
            size = rng.choice([1, 2, 3, 30, 65, 90], 4)
            n, region = int(size.sum()), np.repeat(np.arange(4), size)
            spot, root = rng.integers(0, 300, n), rng.integers(0, 2 * n, n)
            side = rng.integers(0, 2, n) * rng.integers(0, 2, 4)[region]
            got = regions.settle(size, np.zeros(n), side, lambda a, b: np.ones(len(a), bool), Close(spot, step), root)
            two = [len(set(side[region == k].tolist())) > 1 for k in range(4)]
            a, b = np.triu_indices(n, 1)
            linked = (abs(spot[a] - spot[b]) <= 2) & ~(np.array(two)[region[a]] & (side[a] == side[b])) | (root[a] == root[b])
            pairs = [(int(x), int(y)) for x, y in zip(a, b) if region[x] == region[y]]
            pairs = [p for p, yes in zip(pairs, linked[region[a] == region[b]].tolist()) if yes]
            wanted = least_reachable(range(n), pairs)
            classes = [wanted[k] for k in range(n)]
            assert len(set(zip(classes, got.tolist()))) == len(set(classes)) == len(set(got.tolist()))


def test_sieve_passes_all_wanted_and_few_others(make):
    ids = np.random.default_rng(9).integers(-(1 << 63), 1 << 63, 4000)
    words = regions.sieve(make([(int(i),) for i in ids[:1000]], "id long"))
    got = regions.passes(words, ids.view(np.uint64))
    assert got[:1000].all() and got[1000:].mean() < 0.25


def test_packed_members_give_the_regions_of_rows(make, monkeypatch):
    """Members that a task makes of written rows and packs are those of an exploded table, however few travel together."""
    rng = np.random.default_rng(8)
    rows = [(int(i), int(n)) for i, n in zip(rng.choice(10**6, 400, replace=False), rng.integers(1, 30, 400))]
    whole = make(rows, "id long, aux long")

    def members(batch):
        ids, aux = (batch.column(c).to_numpy() for c in ("id", "aux"))
        return np.r_[ids % 150, 1000 + aux], np.r_[ids, ids], np.r_[aux, aux]

    plain = make([r for i, n in rows for r in ((i % 150, i, n), (1000 + n, i, n))], "key long, id long, aux long")
    wanted = sorted(tuple(r) for r in regions._shared(plain).select("key", "id", "aux", "n").collect())
    assert len(wanted) > 500
    for packed, dealt in ((1 << 19, 1 << 17), (7, 50), (100, 1)):
        monkeypatch.setattr(regions, "PACKED", packed)
        monkeypatch.setattr(regions, "DEALT", dealt)
        space = regions.Space(near=lambda a, b: np.ones(len(a), bool), members=members, many=2)
        assert sorted(tuple(r) for r in regions._shared(whole, space).select("key", "id", "aux", "n").collect()) == wanted
    none = make([], "id long, aux long")
    assert regions._shared(none, space).count() == 0
