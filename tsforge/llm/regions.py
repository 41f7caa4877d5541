"""Joins inside overlapping regions, by pivots, recursively and exactly.

A region is a key with members; two items that may be linked share a region. All that matters is
who is connected, so no step makes all pairs of a region.

* Members are dealt by key and sorted, and stream through a task of bounded state. A key with one
  member ends there. A region of at most ``FEW`` members gives its pairs. A crowded one gives one row
  a member, with the region's first member as its pivot: a star.
* Linked stars become components. A region whose members are all connected is finished, which is
  what happens to a group of near copies, however large.
* What is left of a crowded region is dealt in blocks, every two of which meet in one task. There a
  pair is left out when components connect it already, when two members have the same nearest pivot
  at distances that differ by more than the limit (the triangle inequality keeps them apart), or
  when sketches bound it from below. Of the pairs left the task returns a few spanning forests, each of
  fewer edges than members, never the pairs.
* Forest edges are compared. Most link, and connect the region. A region that had more pairs than its
  forests held goes to the next round, which takes four times as many that share no edge, until
  it is connected or no pair is left out.

So the result is exact however crowded a region is, and what a round gives grows with the members.

A space that gives the ``bodies`` of its items needs no rounds. Regions of the same members are one; sketches, where
there are any, cut each region into the parts that they connect; then bodies travel to the parts, whose pairs
are compared where they lie, but for those that are connected by then. A task returns at most one edge a member.
Behind sketches each item goes to its largest part first, and only parts that this leaves open are looked at in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm import text as tx
from tsforge.llm.base import materialise
from tsforge.llm.components import components

#: Members whose pairs are made at once, and members of a block of a crowded region.
FEW, BLOCK = 4, 2048
#: Forests of the first round, and their growth from round to round.
FORESTS = 4
#: Words of sketches that are compared at once.
PAIRS = 1 << 22
#: Members up to which all pairs of a region are listed behind those of its first member, and pairs listed at once.
LISTED, LISTS = 64, 1 << 18
#: Bytes of bodies whose regions are settled together.
HELD = 8 << 20
#: Members that travel together to a part, and members of a part.
PACKED, DEALT = 1 << 18, 1 << 17
#: Bits of a sieve for each wanted id, and at most.
SIEVE, SIEVE_MOST = 8, 1 << 26


class Judge(Protocol):
    """What tells rows of a task apart. ``may(a, b)`` is false only for pairs that do not link; ``links(i, rest)`` is
    exact and given at most ``step`` rows at once, which are not connected with i by then. A judge may have a ``crowd`` too:
    regions of which more rows are left are sifted, and ``sift(begin, end)`` gives, some at a time, the pairs of rows of the
    regions from each begin to its end, but for pairs that do not link."""

    step: int

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    def links(self, i: int, rest: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class Space:
    """What the engine must know of the items.

    ``near(aux, aux)`` and ``bound(bits, aux, aux)``, on arrays, are false only for pairs that
    cannot link; ``bits`` is in how many bits two sketches differ. ``sketches(ids)`` gives (id, aux,
    sketch), with sketches of a power of two of 64-bit words whose halves can be folded by XOR.
    ``compare(pairs)`` adds the distance ``d`` to pairs (a, b), which link up to ``limit``. ``metric`` says
    that d keeps the triangle inequality. ``bodies(ids)`` gives (id, body), once each and others too, and ``judge(bodies,
    keys)`` a judge of rows of regions. ``members(batch)`` makes the arrays (key, id, aux) of members, none of which comes
    twice in a region, of a batch of written rows, ``many`` of a row at most; they travel packed.
    """

    near: Callable[[np.ndarray, np.ndarray], np.ndarray]
    compare: Callable[[DataFrame], DataFrame] | None = None
    limit: float = 0.0
    metric: bool = True
    sketches: Callable[[DataFrame], DataFrame] | None = None
    bound: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None
    bodies: Callable[[DataFrame], DataFrame] | None = None
    judge: Callable[[np.ndarray, np.ndarray], Judge] | None = None
    members: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None
    many: int = 1

    @property
    def rules(self) -> Rules:
        return Rules(self.near, self.bound, self.limit + 1e-9 if self.metric else float("inf"))


@dataclass(frozen=True)
class Rules:
    """The part of a space that tasks need; ``window`` is the widest difference of distances to one pivot."""

    near: Callable[[np.ndarray, np.ndarray], np.ndarray]
    bound: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None
    window: float


class Sketches:
    """Sketches of some rows, folded to each length that occurs among them."""

    def __init__(self, sketch: np.ndarray):
        self.size = np.fromiter(map(len, sketch), dtype=np.int64, count=len(sketch))
        self.place: dict[int, np.ndarray] = {}
        self.words: dict[int, np.ndarray] = {}
        folded = np.zeros((0, 0), dtype=np.uint64)
        rows = np.zeros(0, dtype=np.int64)
        for n in sorted(set(self.size.tolist()), reverse=True):
            while len(rows) and folded.shape[1] * 8 > n:
                folded = folded[:, : folded.shape[1] // 2] ^ folded[:, folded.shape[1] // 2 :]
            mine = np.flatnonzero(self.size == n)
            own = np.frombuffer(b"".join(sketch[mine].tolist()), dtype=np.uint64).reshape(len(mine), -1)
            folded = np.concatenate([folded, own]) if len(rows) else own
            rows = np.r_[rows, mine]
            place = np.full(len(sketch), -1, dtype=np.int64)
            place[rows] = np.arange(len(rows))
            self.place[n], self.words[n] = place, folded

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of the rows differ, at the shorter one's length."""
        out = np.zeros(len(a), dtype=np.int64)
        size = np.minimum(self.size[a], self.size[b])
        for n in set(size.tolist()):
            chosen = np.flatnonzero(size == n)
            place, words = self.place[n], self.words[n]
            step = max(1, PAIRS // words.shape[1])
            for first in range(0, len(chosen), step):
                part = chosen[first : first + step]
                bits = np.bitwise_count(words[place[a[part]]] ^ words[place[b[part]]])
                out[part] = bits.sum(axis=1, dtype=np.int64)
        return out


def may_link(sketch: np.ndarray, aux: np.ndarray, a: np.ndarray, b: np.ndarray, bound) -> np.ndarray:
    """Whether the bound lets the pairs of rows (a, b) link."""
    return bound(Sketches(sketch).differ(a, b), aux[a], aux[b])


class Stars:
    """Regions of batches sorted by (key, id): pairs of small ones, stars of crowded ones."""

    def __init__(self, near):
        self.near = near
        self.held: tuple[np.ndarray, ...] | None = None
        self.crowded = False

    def feed(self, key: np.ndarray, ids: np.ndarray, aux: np.ndarray, end: bool = False):
        """(pairs (a, b), crowd (key, id, aux, pivot)) that are settled by these rows."""
        old = 0
        if self.held is not None:
            old = len(self.held[0]) if self.crowded else 0
            key, ids, aux = (np.concatenate(x) for x in zip(self.held, (key, ids, aux)))
        fresh = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])][: len(key)]
        key, ids, aux = key[fresh], ids[fresh], aux[fresh]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        size = np.diff(np.r_[start, len(key)])
        crowd = size > FEW
        crowd[:1] |= self.crowded
        settled = np.ones(len(start), dtype=bool)
        if len(start) and not end:
            # The last region may go on: few members wait, of a crowd the pivot and the last member.
            last, self.crowded = start[-1], bool(crowd[-1])
            keep = np.array([last, len(key) - 1]) if self.crowded else np.arange(last, len(key))
            self.held = key[keep], ids[keep], aux[keep]
            settled[-1] = self.crowded
        row_crowd = np.repeat(crowd & settled, size)
        row_few = np.repeat(~crowd & settled, size)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, FEW):
            a = np.flatnonzero(row_few[:-step] & (key[:-step] == key[step:]))
            a = a[self.near(aux[a], aux[a + step])]
            left.append(ids[a])
            right.append(ids[a + step])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        row_crowd[:old] = False
        rows = np.flatnonzero(row_crowd)
        pivot = np.repeat(start, size)[rows]
        pivot = np.where(self.near(aux[pivot], aux[rows]), ids[pivot], ids[rows])
        return pairs, (key[rows], ids[rows], aux[rows], pivot)


def _stars(members: DataFrame, space: Space) -> DataFrame:
    """(key, id, aux, pivot) of crowded regions, and pairs of small ones as (null, b, null, a)."""
    near = space.near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = Stars(near)
        none = np.zeros(0, dtype=np.int64)

        def out(pairs, crowd):
            key, ids, aux, pivot = crowd
            gap = pa.nulls(len(pairs), pa.int64())
            columns = [
                pa.concat_arrays([gap, pa.array(key)]),
                pa.array(np.r_[pairs[:, 1], ids]),
                pa.concat_arrays([gap, pa.array(aux)]),
                pa.array(np.r_[pairs[:, 0], pivot]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["key", "id", "aux", "pivot"])

        for batch in batches:
            if batch.num_rows:
                found = out(*stars.feed(*(batch.column(c).to_numpy() for c in ("key", "id", "aux"))))
                if found.num_rows:
                    yield found
        if stars.held is not None and not stars.crowded:
            yield out(*stars.feed(none, none, none, end=True))

    dealt = members.select("key", "id", "aux").repartition("key").sortWithinPartitions("key", "id")
    return materialise(dealt.mapInArrow(run, "key long, id long, aux long, pivot long"), "stars")


def forests(members: dict[str, np.ndarray], rules: Rules, many: int) -> tuple[list[tuple[int, int]], bool]:
    """Edges (a, b) of ``many`` forests over the pairs of one region that may link, and whether pairs are left out.

    Members of one root are connected already. Where ``side`` differs among members, only pairs of both sides count.
    """
    root, side = members["root"], members["side"]
    _, code, count = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((members["id"], code, count[code]))
    got = {c: x[order] for c, x in members.items()}
    code, ids, aux, side = code[order], got["id"], got["aux"], side[order]
    both = bool((side != side[0]).any())
    labels = [code.copy() for _ in range(many)]
    sketches = Sketches(got["sketch"]) if "sketch" in got else None
    edges, left_out = [], False
    for i in range(int((code != code[-1]).sum())):
        rest = i + 1 + np.flatnonzero(code[i + 1 :] != code[i])
        if both:
            rest = rest[side[rest] != side[i]]
        if many == 1 and left_out:
            rest = rest[labels[0][rest] != labels[0][i]]
        rest = rest[rules.near(np.broadcast_to(aux[i], len(rest)), aux[rest])]
        apart = (got["home"][rest] == got["home"][i]) & (np.abs(got["away"][rest] - got["away"][i]) > rules.window)
        rest = rest[~apart]
        if sketches is not None and len(rest):
            at = np.broadcast_to(i, len(rest))
            rest = rest[rules.bound(sketches.differ(at, rest), aux[at], aux[rest])]
        for label in labels:
            if not len(rest):
                break
            _, first = np.unique(label[rest], return_index=True)
            first = first[label[rest[first]] != label[i]]
            chosen = rest[first]
            edges += [(int(min(ids[i], b)), int(max(ids[i], b))) for b in ids[chosen]]
            label[np.isin(label, label[chosen])] = label[i]
            rest = np.delete(rest, first)
        left_out |= len(rest) > 0
    return edges, left_out


def _round(dealt: DataFrame, space: Space, many: int) -> DataFrame:
    """(key, a, b): forest edges, and (key, null, null) of regions with pairs left out."""
    names, rules = dealt.columns, space.rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(parts):
            got = {c: np.concatenate([p[c] for p in parts]) for c in names}
            edges, left_out = forests(got, rules, many)
            a, b = [x for x, _ in edges], [y for _, y in edges]
            if left_out:
                a, b = [*a, None], [*b, None]
            key = np.repeat(got["key"][:1], len(a))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])

        parts, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            change = np.r_[True, (got["key"][1:] != got["key"][:-1]) | (got["part"][1:] != got["part"][:-1])]
            edges = np.r_[np.flatnonzero(change), batch.num_rows]
            for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
                now = got["key"][first], got["part"][first]
                if parts and now != at:
                    yield settle(parts)
                    parts = []
                at = now
                parts.append({n: x[first:last] for n, x in got.items()})
        if parts:
            yield settle(parts)

    spread = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "id")
    return materialise(spread.mapInArrow(run, "key long, a long, b long"), "forests")


def _in_blocks(open_: DataFrame) -> DataFrame:
    """Members once for every other block of their region, with (part, side); one part holds two blocks."""
    sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = open_.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A block alone (part = its own pair) has one side; two blocks have two.
    part = F.least("mine", "other").cast("long") * F.col("blocks") + F.greatest("mine", "other")
    return rows.withColumn("part", part).withColumn("side", (F.col("mine") > F.col("other")).cast("int")).drop("blocks", "mine", "other")


def connect(members: DataFrame, space: Space) -> DataFrame:
    """(id, root) of all items that are linked, directly or not, to another.

    ``members`` (key, id, aux) are the regions. A pair links when its distance is at most the limit.
    """
    if space.bodies:
        return _settled(members, space)
    found = _stars(members, space)
    crowd = found.filter("key IS NOT NULL").select("key", "id", "aux")
    pairs = found.filter("pivot <> id").groupBy(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))
    pairs = materialise(pairs.agg(F.count("*").alias("met")), "pairs")
    sketches = None
    if space.sketches:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowd.select("id")).distinct()
        sketches = materialise(space.sketches(ids), "sketches")
        pairs = _bounded(pairs, space, sketches)

    # Each item with the pivot that it meets most often, then the other pairs that are not connected by then.
    likely = pairs.groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a")).select("a", "b")
    known = materialise(space.compare(likely), "distances")
    roots = _roots(known, space)
    known, roots = _learn(pairs.select("a", "b"), known, roots, space)

    many, live = FORESTS, None
    while True:
        open_ = _open(crowd if live is None else crowd.join(live, "key", "left_semi"), roots, known, sketches)
        if open_.isEmpty():
            return roots
        found = _round(_in_blocks(open_), space, many)
        live = materialise(found.filter("a IS NULL").select("key").distinct(), "live")
        known, roots = _learn(found.filter("a IS NOT NULL").select("a", "b").distinct(), known, roots, space)
        many *= FORESTS


def _learn(pairs: DataFrame, known: DataFrame, roots: DataFrame, space: Space) -> tuple[DataFrame, DataFrame]:
    """What is known, and the roots, after the comparison of those pairs that are neither known nor connected."""
    apart = _with_root(_with_root(pairs, roots, "a", "ra"), roots, "b", "rb").filter("ra <> rb").select("a", "b")
    more = materialise(apart.join(known.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return known, roots
    known = known.unionByName(materialise(space.compare(more), "distances"))
    return known, _roots(known, space)


def _bounded(pairs: DataFrame, space: Space, sketches: DataFrame) -> DataFrame:
    """The pairs that the sketches let link."""
    left = sketches.select(F.col("id").alias("a"), F.col("aux").alias("aux_a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("id").alias("b"), F.col("aux").alias("aux_b"), F.col("sketch").alias("sketch_b"))

    bound = space.bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            got = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            both = np.concatenate([got["sketch_a"], got["sketch_b"]])
            aux = np.concatenate([got["aux_a"], got["aux_b"]])
            keep = may_link(both, aux, np.arange(n), n + np.arange(n), bound)
            yield pa.RecordBatch.from_arrays([pa.array(got[c][keep]) for c in ("a", "b", "met")], names=["a", "b", "met"])

    joined = pairs.join(right, "b").join(left, "a")
    return materialise(joined.mapInArrow(run, "a long, b long, met long"), "pairs")


def _roots(known: DataFrame, space: Space) -> DataFrame:
    return materialise(components(known.filter(F.col("d") <= space.limit)), "roots")


def _with_root(rows: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    part = roots.select(F.col("id").alias(column), F.col("root").alias(name))
    return rows.join(part, column, "left").withColumn(name, F.coalesce(name, column))


def _open(crowd: DataFrame, roots: DataFrame, known: DataFrame, sketches: DataFrame | None) -> DataFrame:
    """Members of crowded regions that are not all connected, with what is known of each."""
    state = materialise(_with_root(crowd, roots, "id", "root"), "crowd")
    span = state.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    live = materialise(span.filter("lo < hi").select("key"), "live")
    home = known.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("d", "a")).alias("near"))
    home = home.select("id", F.col("near.a").alias("home"), F.col("near.d").alias("away"))
    state = state.join(live, "key").join(home, "id", "left")
    columns = [F.coalesce("home", "id").alias("home"), F.coalesce("away", F.lit(0.0)).alias("away")]
    if sketches is None:
        return materialise(state.select("key", "id", "aux", "root", *columns), "open")
    state = state.join(sketches.select("id", "sketch"), "id")
    return materialise(state.select("key", "id", "aux", "root", *columns, "sketch"), "open")


class Shared:
    """Members of batches sorted by key whose region has others, and a mark for each of these regions.

    Where members come twice, batches are sorted by (key, id)."""

    def __init__(self):
        self.held: tuple[np.ndarray, ...] | None = None
        self.told, self.total, self.count = False, np.uint64(0), 0

    def feed(self, key: np.ndarray, ids: np.ndarray, aux: np.ndarray, end: bool = False):
        """(members (key, id, aux), marks (key, members, sum of the mixed ids)) that are settled by these rows."""
        old = self.held is not None
        if old:
            key, ids, aux = (np.concatenate(x) for x in zip(self.held, (key, ids, aux)))
        fresh = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])][: len(key)]
        key, ids, aux = key[fresh], ids[fresh], aux[fresh]
        again = key[1:] == key[:-1]
        shared = (np.r_[False, again] | np.r_[again, False])[: len(key)]
        start = np.flatnonzero(np.r_[True, ~again][: len(key)])
        count, mixed = np.diff(np.r_[start, len(key)]), tx.mix(ids.view(np.uint64) ^ tx.BASE)
        if old:
            # The held row is in the sums of its region already.
            mixed[0], shared[0] = self.total, shared[0] and not self.told
            count[0] += self.count - 1
        total = np.add.reduceat(mixed, start) if len(start) else mixed
        if len(key) and not end:
            told = self.told if old and len(key) == 1 else count[-1] > 1
            self.held, self.told, self.total, self.count = (key[-1:], ids[-1:], aux[-1:]), bool(told), total[-1], int(count[-1])
        done = count > 1
        if not end:
            done[-1:] = False
        return (key[shared], ids[shared], aux[shared]), (key[start][done], count[done], total[done].view(np.int64))


def _by_key(members: DataFrame, space: Space | None) -> tuple[DataFrame, Callable]:
    """Rows that hold the members of whole regions, and what reads them in a task as (key, id, aux, whether no region goes on)."""
    make = space.members if space else None
    if make is None:
        dealt = members.select("key", "id", "aux").repartition("key").sortWithinPartitions("key", "id")
        return dealt, lambda batches: ((*(b.column(c).to_numpy() for c in ("key", "id", "aux")), False) for b in batches if b.num_rows)
    # A part holds whole regions and about DEALT members, which are sorted in one step.
    parts = np.uint64(max(1, -(-members.count() * space.many // DEALT)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            rows = np.stack([np.concatenate(x) for x in zip(*held)], axis=1)
            part = (tx.mix(rows[:, 0].view(np.uint64)) % parts).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            offsets = (np.r_[head, len(part)] * rows.itemsize * 3).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(rows[order])])
            return pa.RecordBatch.from_arrays([pa.array(part[head]), packed], names=["part", "rows"])

        held, n = [], 0
        for batch in batches:
            held.append(make(batch))
            n += len(held[-1][0])
            if n >= PACKED:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    def read(batches: Iterator[pa.RecordBatch]):
        held, at = [], None

        def done():
            rows = np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 3)
            rows = rows[np.argsort(rows[:, 0])]
            return *np.ascontiguousarray(rows.T), True

        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist()):
                if held and part != at:
                    yield done()
                    held.clear()
                at = part
                held.append(rows)
        if held:
            yield done()

    packed = members.mapInArrow(pack, "part int, rows binary")
    return packed.repartition("part").sortWithinPartitions("part"), read


def _shared(members: DataFrame, space: Space | None = None) -> DataFrame:
    """(key, id, aux, n) of regions with more than one member, one region, that of the least key, of those with the same members."""
    dealt, read = _by_key(members, space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Shared()
        none = np.zeros(0, dtype=np.int64)

        def out(rows, marks):
            gaps = pa.nulls(len(marks[0]), pa.int64()), pa.nulls(len(rows[0]), pa.int64())
            columns = [
                pa.array(np.r_[rows[0], marks[0]]),
                pa.concat_arrays([pa.array(rows[1]), gaps[0]]),
                pa.array(np.r_[rows[2], marks[1]]),
                pa.concat_arrays([gaps[1], pa.array(marks[2])]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["key", "id", "aux", "mark"])

        for key, ids, aux, whole in read(batches):
            found = out(*(Shared() if whole else shared).feed(key, ids, aux, end=whole))
            if found.num_rows:
                yield found
        if shared.held is not None:
            yield out(*shared.feed(none, none, none, end=True))

    found = materialise(dealt.mapInArrow(run, "key long, id long, aux long, mark long"), "shared")
    regions = found.filter("id IS NULL").groupBy("mark", F.col("aux").alias("n")).agg(F.min("key").alias("key"))
    return materialise(found.filter("id IS NOT NULL").drop("mark").join(regions.drop("mark"), "key"), "regions")


def sieve(ids: DataFrame) -> np.ndarray:
    """A bitmap that all these ids (hashes) pass and few others, of bounded size."""
    cells = 64
    while cells < SIEVE * ids.count() and cells < SIEVE_MOST:
        cells *= 2
    cell = F.col("id").bitwiseAND(F.lit(cells - 1))
    bit = F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    rows = ids.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(cells // 64, dtype=np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids (as unsigned) pass a sieve."""
    cell = ids & np.uint64(64 * len(words) - 1)
    return (words[(cell >> np.uint64(6)).astype(np.int64)] >> (ids & np.uint64(63)) & np.uint64(1)) > 0


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each begin up to its end."""
    n = end - begin
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def settle(size: np.ndarray, aux: np.ndarray, side: np.ndarray, near, judge: Judge, root: np.ndarray | None = None) -> np.ndarray:
    """A label for each row, the same where rows of a region are linked, directly or not, or have the same root.

    Rows lie region by region, of ``size`` rows each. Where ``side`` differs in a region, only pairs of both sides count.
    """
    parent = list(range(len(aux)))
    if root is not None and len(root):
        region = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((root, region))
        head = np.r_[True, (np.diff(root[order]) != 0) | (np.diff(region[order]) != 0)]
        at = np.flatnonzero(head)
        known = np.zeros(len(aux), dtype=np.int64)
        known[order] = np.repeat(order[at], np.diff(np.r_[at, len(order)]))
        parent = known.tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(i: int, rest: np.ndarray) -> list[int]:
        linked = []
        for lo in range(0, len(rest), judge.step):
            root = find(i)
            part = np.array([j for j in rest[lo : lo + judge.step].tolist() if find(j) != root], dtype=np.int64)
            if len(part):
                for j in part[judge.links(i, part)].tolist():
                    parent[find(j)] = find(i)
                    linked.append(j)
        return linked

    last = np.cumsum(size)
    first = last - size
    two = np.maximum.reduceat(side, first) != np.minimum.reduceat(side, first) if len(size) else size > 0
    mixed = np.repeat(two, size)
    label = np.zeros(len(aux), dtype=np.int64)

    def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are not connected by now."""
        met = np.zeros(len(aux), dtype=bool)
        met[i] = met[j] = True
        rows = np.flatnonzero(met)
        label[rows] = [find(x) for x in rows.tolist()]
        return label[i] != label[j]

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        """Connects what links of the pairs, which lie together by i."""
        keep = apart(i, j) & near(aux[i], aux[j]) & ~(mixed[i] & (side[i] == side[j]))
        i, j = i[keep], j[keep]
        keep = judge.may(i, j)
        i, j = i[keep], j[keep]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(i)]):
            join(int(i[s]), j[s:e])

    # The first row of each region against the others of it, then what this leaves unconnected: all rows of a small region,
    # of a larger one a few, then more at once. A crowd of copies is connected after the first; other crowds are sifted.
    begin, stop, end = first, first + 1, last
    small, crowd = size <= LISTED, getattr(judge, "crowd", float("inf"))
    while len(begin):
        stop = np.minimum(stop, end - 1)
        a, n = _ranges(begin, stop), np.repeat(end, stop - begin)
        n -= a + 1
        total, lo = np.cumsum(n), 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] - n[lo] + LISTS, side="right")))
            compare(np.repeat(a[lo:hi], n[lo:hi]), _ranges(a[lo:hi] + 1, a[lo:hi] + 1 + n[lo:hi]))
            lo = hi
        rows = _ranges(begin, end)
        label[rows] = [find(x) for x in rows.tolist()]
        edges = np.cumsum(end - begin) - (end - begin)
        open_ = (stop < end - 1) & (np.maximum.reduceat(label[rows], edges) != np.minimum.reduceat(label[rows], edges))
        crowded = open_ & (end - stop > crowd)
        if crowded.any():
            for i, j in judge.sift(stop[crowded], end[crowded]):
                order, many = np.lexsort((j, i)), 1
                i, j = i[order], j[order]
                # Each row with one other, then with more at once of those that this leaves apart.
                while (keep := apart(i, j)).any():
                    i, j = i[keep], j[keep]
                    head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    now = np.arange(len(i)) - np.repeat(head, np.diff(np.r_[head, len(i)])) < many
                    compare(i[now], j[now])
                    i, j, many = i[~now], j[~now], 2 * many
            open_ &= ~crowded
        step = np.where(small, end - begin, np.minimum(2 * (stop - begin), np.maximum(1, LISTS // np.maximum(end - begin, 1))))
        begin, stop, end, small = stop[open_], (stop + step)[open_], end[open_], small[open_]
    return np.fromiter(map(find, range(len(parent))), dtype=np.int64, count=len(parent))


class _Bounds:
    """Sketches as a judge: what they let link counts as linked."""

    step = 1 << 30

    def __init__(self, sketch: np.ndarray, aux: np.ndarray, bound):
        self.sketches, self.aux, self.bound = Sketches(sketch), aux, bound

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.bound(self.sketches.differ(a, b), self.aux[a], self.aux[b])

    def links(self, i: int, rest: np.ndarray) -> np.ndarray:
        return np.ones(len(rest), dtype=bool)


def _labelled(members: DataFrame, bodies: DataFrame, near, judge, out, ddl: str) -> DataFrame:
    """``out(ids, aux, labels)`` of the members (key, id, aux, n, root) of each task, labelled by what its regions link."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.least("mine", "other").cast("long") * F.col("blocks") + F.greatest("mine", "other")
    side = (F.col("mine") > F.col("other")).cast("int")
    rows = rows.select("key", part.alias("part"), side.alias("side"), "id", "aux", "root").join(bodies.select("id", "body"), "id")
    names = ["key", "part", "side", "id", "aux", "root", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(got):
            change = np.r_[True, (got["key"][1:] != got["key"][:-1]) | (got["part"][1:] != got["part"][:-1])]
            size = np.diff(np.r_[np.flatnonzero(change), len(change)])
            judged = judge(got["body"], got["aux"], got["key"])
            return out(got["id"], got["aux"], settle(size, got["aux"], got["side"], near, judged, got["root"]))

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in names})
            size += batch.column("body").nbytes
            if size < HELD:
                continue
            # The last region may go on; all before it are settled at once.
            got = {n: np.concatenate([p[n] for p in held]) for n in names}
            change = (got["key"] != got["key"][-1]) | (got["part"] != got["part"][-1])
            cut = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
            if cut:
                yield done({n: x[:cut] for n, x in got.items()})
            held = [{n: x[cut:] for n, x in got.items()}]
            size = sum(map(len, held[0]["body"]))
        if held:
            yield done({n: np.concatenate([p[n] for p in held]) for n in names})

    spread = rows.repartition("key", "part").sortWithinPartitions("key", "part", "id").select(*names)
    return spread.mapInArrow(run, ddl)


def _parts(ids: np.ndarray, aux: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """(key, id, aux, n) of labels with more than one row; the key tells the members."""
    _, code, count = np.unique(label, return_inverse=True, return_counts=True)
    total = np.zeros(len(count), dtype=np.uint64)
    np.add.at(total, code, tx.mix(ids.view(np.uint64) ^ tx.BASE))
    key, many = tx.mix(total + count.astype(np.uint64)).view(np.int64)[code], count[code].astype(np.int64)
    keep = many > 1
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, ids, aux, many)], names=["key", "id", "aux", "n"])


def _edges(ids: np.ndarray, aux: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """(a, b): each row that is not its label's own, with that one."""
    keep = label != np.arange(len(label))
    return pa.RecordBatch.from_arrays([pa.array(ids[label[keep]]), pa.array(ids[keep])], names=["a", "b"])


def _settled(members: DataFrame, space: Space) -> DataFrame:
    """``connect`` for items whose bodies travel to the regions."""
    regions, own = _shared(members, space), F.col("id").alias("root")
    if space.sketches:
        ids = materialise(regions.select("id").distinct(), "ids")
        sketches = space.sketches(ids).withColumnRenamed("sketch", "body")
        judge = lambda body, aux, key, bound=space.bound: _Bounds(body, aux, bound)
        found = _labelled(regions.select("*", own), sketches, space.near, judge, _parts, "key long, id long, aux long, n long")
        regions = materialise(found.dropDuplicates(["key", "id"]), "regions")
    ids = materialise(regions.select("id").distinct(), "ids")
    bodies = space.bodies(ids)
    judge = lambda body, aux, key, judge=space.judge: judge(body, key)

    def links(rows: DataFrame) -> DataFrame:
        return materialise(_labelled(rows, bodies, space.near, judge, _edges, "a long, b long"), "links")

    if not space.sketches:
        return materialise(components(links(regions.select("*", own))), "roots")
    # What sketches let meet mostly links: each item in its largest region first, then the regions that this leaves open.
    largest = regions.groupBy("id").agg(F.max_by(F.struct("key", "aux", "n"), F.struct("n", "key")).alias("best"))
    found = links(largest.select("best.*", "id", own))
    state = materialise(_with_root(regions, materialise(components(found), "roots"), "id", "root"), "state")
    live = state.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    return materialise(components(found.union(links(state.join(live, "key", "left_semi")))), "roots")
