"""Exact Jaccard join of documents on 5-word shingles, as a join of a metric space.

Jaccard distance is a metric, and two documents link at distance 0.25 or less. Most documents
are at distance 1 of each other, where document pivots tell nothing, so the outermost pivots are
single shingles: the distance of a document to the pivot {s} is 1 - 1/n if s is one of its n
shingles, else 1, so its nearest pivots are its own shingles, and ties are broken by one global
order. A document can only link to one that it shares at least 3/4 of its shingles with, so the
window around the regions' boundaries is the first n - ceil(3n/4) + 1 shingles of that order: two
linked documents meet in at least one region. The order puts shingles that many documents
share last (counted over all documents), then goes by hash. See ``regions`` for what happens inside: regions
of the same documents are one, parity sketches, which bound the difference of two sets from below, cut a
region into the parts that may be connected, and texts travel to these parts only, for an exact comparison.

Equal sets are one class, so copies are compared once. Sets are of 64-bit shingle hashes.

Defined results: a document without words (null, empty, white space) has the empty set, links
with nothing and is its own component. Fewer than five words are one shingle. Rows that repeat
an id each get their own set; a row without an id gets the smallest id of its component, null if
there is none. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import text as tx
from tsforge.llm.base import materialise, query, table
from tsforge.llm.regions import Space, connect, passes, sieve

#: A shingle counts as common from this share of a batch's sets on; as many common ones are kept.
COMMON_SHARE, COMMON_LEAST, COMMON = 0.0005, 4, 1 << 17


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, offsets, set hash) by slices of texts."""
    for first, raw, offsets in tx.slices(column):
        sets, at = tx.shingle_sets(raw, offsets)
        yield first, sets, at, tx.set_hashes(sets, at)


def _one_of_each(ids: np.ndarray, seen: set[int]) -> np.ndarray:
    """Positions of nonempty sets not met before."""
    out = []
    for k, i in enumerate(ids.tolist()):
        if i and i not in seen:
            seen.add(i)
            out.append(k)
    return np.array(out, dtype=np.int64)


def _spread(sets: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of these rows, position of the row of each)."""
    n = at[rows + 1] - at[rows]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return sets[np.repeat(at[rows], n) + inside], np.repeat(np.arange(len(rows)), n)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(0, doc_id, set, size) of each row; (1, null, shingle, sets of the batch that hold it) of common ones."""
    names = ["what", "doc_id", "id", "n"]
    for batch in batches:
        ids, sizes, parts, seen = [], [], [], set()
        for _, sets, at, key in _sets(batch.column("text")):
            ids.append(key)
            sizes.append(np.diff(at))
            parts.append(_spread(sets, at, _one_of_each(key, seen))[0])
        if not ids:
            continue
        key = np.concatenate(ids).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(key), dtype=np.int32)), batch.column("doc_id"), pa.array(key), pa.array(np.concatenate(sizes))],
            names=names,
        )
        flat = np.concatenate(parts)
        parts.clear()
        flat.sort()
        start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]][: len(flat)])
        n = np.diff(np.r_[start, len(flat)])
        often = n >= max(COMMON_LEAST, COMMON_SHARE * len(seen))
        shingle, n = flat[start[often]].view(np.int64), n[often]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(n), dtype=np.int32)), pa.nulls(len(n), pa.int64()), pa.array(shingle), pa.array(n)], names=names
        )


def prefixes(
    sets: np.ndarray, at: np.ndarray, rows: np.ndarray, common: np.ndarray, count: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, position of the row) of the windows of these rows; ``common`` is sorted."""
    flat, row = _spread(sets, at, rows)
    size = at[rows + 1] - at[rows]
    want = size - (3 * size + 3) // 4 + 1
    if len(common):
        place = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        often = np.where(common[place] == flat, count[place], 0)
    else:
        often = np.zeros(len(flat), dtype=np.int64)
    rare = often == 0
    first = np.cumsum(size) - size
    before = np.r_[0, np.cumsum(rare)]
    n_rare = before[first + size] - before[first]
    take = rare & (before[:-1] - before[first][row] < want[row])
    late = np.flatnonzero(~rare & (n_rare < want)[row])
    late = late[np.lexsort((flat[late], often[late], row[late]))]
    start = np.searchsorted(row[late], np.arange(len(rows)))
    late = late[np.arange(len(late)) - start[row[late]] < (want - n_rare)[row[late]]]
    chosen = np.r_[np.flatnonzero(take), late]
    return flat[chosen], row[chosen]


def _members(docs: DataFrame, common: np.ndarray, count: np.ndarray) -> DataFrame:
    """(key, id, aux): the regions of each set, with its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for _, sets, at, ids in _sets(batch.column("text")):
                rows = _one_of_each(ids, seen)
                if not len(rows):
                    continue
                shingle, row = prefixes(sets, at, rows, common, count)
                size = at[rows + 1] - at[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle.view(np.int64)), pa.array(ids[rows][row].view(np.int64)), pa.array(size[row])],
                    names=["key", "id", "aux"],
                )

    return docs.select("text").mapInArrow(run, "key long, id long, aux long")


def similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes at which an overlap of 3/4 of the union is possible."""
    return 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)


def _of_sets(docs: DataFrame, ids: DataFrame, make: Callable[[np.ndarray], bytes] | None, name: str) -> DataFrame:
    """(id, aux, ``name``): size and ``make(shingles)`` of these sets, or one text of each, which is smaller on disk."""
    words = docs.sparkSession.sparkContext.broadcast(sieve(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for first, sets, at, keys in _sets(batch.column("text")):
                rows = _one_of_each(keys, seen)
                rows = rows[passes(words.value, keys[rows])]
                if make:
                    made = pa.array([make(sets[at[r] : at[r + 1]]) for r in rows.tolist()], type=pa.binary())
                else:
                    made = batch.column("text").take(pa.array(rows + first)).cast(pa.binary())
                size = (at[rows + 1] - at[rows]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[rows].view(np.int64)), pa.array(size), made],
                    names=["id", "aux", name],
                )

    found = docs.select("text").mapInArrow(run, f"id long, aux long, {name} binary")
    return materialise(found.join(ids, "id").dropDuplicates(["id"]), name)


class Sets:
    """The sets of texts as a judge of links."""

    step = 1 << 30

    def __init__(self, body: np.ndarray, key: np.ndarray):
        found = [(sets, np.diff(at)) for _, sets, at, _ in _sets(pa.array(body.tolist(), type=pa.large_binary()).cast(pa.large_string()))]
        self.size = np.concatenate([n for _, n in found])
        self.at = np.r_[0, np.cumsum(self.size)]
        shingles, code = np.unique(np.concatenate([sets for sets, _ in found]), return_inverse=True)
        self.code, self.own = code, np.zeros(len(shingles), dtype=bool)

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.ones(len(a), dtype=bool)

    def links(self, i: int, rest: np.ndarray) -> np.ndarray:
        mine = self.code[self.at[i] : self.at[i + 1]]
        self.own[mine] = True
        flat, row = _spread(self.code, self.at, rest)
        shared = np.bincount(row[self.own[flat]], minlength=len(rest))
        self.own[mine] = False
        return 4 * shared >= 3 * (len(mine) + self.size[rest] - shared)


def parity(sets: np.ndarray) -> bytes:
    """One bit for each of 2**k >= n cells: whether an odd number of the n shingles falls in it.

    Two such sketches differ in no more bits than the sets have shingles that the other lacks.
    """
    cells = 64
    while cells < len(sets):
        cells *= 2
    count = np.bincount((sets & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits(count & 1, bitorder="little").tobytes()


def within_limit(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A link has at most 1/7 of both sizes as difference: 4 shared >= 3 union."""
    return 7 * bits <= a + b


def near_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = materialise(docs.mapInArrow(_profile, "what int, doc_id long, id long, n long"), "profile")
    rows = profile.filter("what = 0").select("doc_id", F.col("id").alias("set_id"), F.col("n").alias("n_shingles"))
    often = profile.filter("what = 1").groupBy("id").agg(F.sum("n").alias("n"))
    # At most COMMON rows; which ones only decides the order of shingles, never the result.
    often = often.orderBy(F.desc("n"), "id").limit(COMMON).toArrow()
    common, count = often["id"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(common)
    members = _members(docs, common[order], count[order])
    space = Space(
        near=similar_sizes,
        sketches=lambda ids: _of_sets(docs, ids, parity, "sketch"),
        bound=within_limit,
        bodies=lambda ids: _of_sets(docs, ids, None, "body"),
        judge=Sets,
    )
    roots = connect(members, space)

    classes = rows.filter("set_id <> 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots.withColumnRenamed("id", "set_id"), "set_id", "left")
    classes = classes.withColumn("root", F.coalesce("root", "set_id"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(classes.join(smallest, "root").select("set_id", "component_id"), "classes")
    return rows.join(classes, "set_id", "left").select(
        "doc_id",
        "set_id",
        "n_shingles",
        F.when(F.col("set_id") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does.

    The document with the smallest id stays, of rows that repeat its id and set one. Documents
    without words all stay.
    """

    @F.arrow_udf("long")
    def set_id(column: pa.Array) -> pa.Array:
        keys = [k for _, _, _, k in _sets(column)]
        return pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64))

    joined = near_documents(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("set_id") != 0))
    stay = joined.select(F.col("doc_id").alias("_keep"), F.col("set_id").alias("_kept_set")).distinct()
    whole = docs.select(F.struct("*").alias("_row"), set_id("text").alias("_set"))
    empty = whole.filter("_set = 0").select("_row.*")
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_keep")) & (F.col("_set") == F.col("_kept_set"))
    first = whole.filter("_set <> 0").join(stay, same).dropDuplicates(["_keep", "_kept_set"])
    return first.select("_row.*").unionByName(empty)


_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""


@query("op3_jaccard_join", _SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return near_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
