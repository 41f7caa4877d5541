"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks of about ``BLOCK`` bytes of text: one row per term of a block with
its postings, and one row with the lengths of the block's documents. Only terms that some item asks
for are kept; a bitmap of fixed size, whatever the number of items, says which (a few more pass and
are dropped by the join on the term itself).

Terms have owners, ordered from rare to common terms by the share of documents that hold them.
Items travel in bundles: for each bundle and block, a state holds the lengths of the documents
and, for each item, a sparse accumulator (documents, scores). The state goes through the owners one
after the other; at each, ``cogroup`` brings it together with the postings of that owner's terms for
this bundle and block, and their integer contributions are added. Since common terms come last,
accumulators are small while they travel. The last owner selects the best documents of the
block, and these few are ranked over all blocks.

A term's weight is ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; a document with n terms has
``m = 100 - B + (B n N) div L``, and a term with tf occurrences adds ``w (10**9 tf div (1000 tf + 8 m))``.

Defined results: null text has no terms. Every row is a document, rows that repeat an id included;
equal scores go by ascending doc_id, null last. Every benchmark row is an item, repeats of
an id are ranked by themselves. An item without terms, or whose terms nobody holds, has no rows. Empty
tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsforge.llm import terms as tm
from tsforge.llm import text as tx
from tsforge.llm.base import materialise, query, table

TOP, LENGTH_WEIGHT = 10, 75
#: Bytes of text in a block, items in a bundle, bits of the bitmap, and the largest share of the
#: documents that a term of each owner but the last may be in.
BLOCK, BUNDLE, BITS, OWNERS = 1 << 23, 128, 1 << 22, (1 / 1024, 1 / 128, 1 / 16)
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BUCKET = 32_768
_INDEX = pa.schema([
    ("block", pa.int64()), ("term", pa.string()), ("local", pa.list_(pa.int32())), ("value", pa.list_(pa.int64())),
    ("ids", pa.list_(pa.int64())),
])
_INDEX_DDL = "block long, term string, local array<int>, value array<long>, ids array<long>"
_STATE = pa.schema([
    ("bundle", pa.int32()), ("block", pa.int64()), ("item", pa.int64()), ("local", pa.list_(pa.int32())),
    ("value", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())),
])
_STATE_DDL = "bundle int, block long, item long, local array<int>, value array<long>, ids array<long>"


def _place(names: pa.Array) -> np.ndarray:
    """The bit of each term."""
    names = names.cast(pa.large_string())
    _, offsets, data = names.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[names.offset : names.offset + len(names) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return (tx.span_hashes(raw, at[:-1], at[1:]) % np.uint64(BITS)).astype(np.int64)


def wanted_bits(terms: DataFrame) -> bytes:
    """The bitmap of the terms of all items, BITS / 8 bytes."""
    place = F.arrow_udf(lambda names: pa.array(_place(names)), "long")
    bits = terms.select("term").distinct().select(place("term").alias("bit"))
    buckets = bits.groupBy(F.expr(f"bit div {_BUCKET}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("bit") % _BUCKET).alias("bits")
    )
    out = bytearray(BITS // 8)
    for row in buckets.toArrow().to_pylist():
        out[row["bucket"] * _BUCKET // 8 : (row["bucket"] + 1) * _BUCKET // 8] = row["bits"]
    return bytes(out)


def _lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, type=kind))


def index(docs: DataFrame, wanted: bytes) -> DataFrame:
    """Blocks of postings, written. A row without a term is a block's ``ids`` and lengths (``value``);
    any other row is a term, its documents (``local``, places in the block) and occurrences."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(np.frombuffer(wanted, dtype=np.uint8), bitorder="little").astype(bool)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for t in tm.slices(batch.column(1), tm.NOT_LETTER_OR_DIGIT, BLOCK):
                length = np.bincount(t.doc, minlength=t.docs)
                asked = bitmap[_place(t.names)]
                here = asked[t.term] if len(t.term) else np.zeros(0, dtype=bool)
                t.term, t.doc = t.term[here], t.doc[here]
                doc, term, n = t.counts()
                first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
                ids = batch.column(0).slice(t.first, t.docs)
                names = pa.concat_arrays([pa.nulls(1, pa.string()), t.names.take(pa.array(term[first])).cast(pa.string())])
                rows = len(names)
                only_first = pa.array(np.arange(rows) > 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(rows, block)), names,
                    _lists(doc, np.r_[0, 0, first[1:], len(doc)][: rows + 1], pa.int32()),
                    _lists(np.r_[length, n], np.r_[0, t.docs, t.docs + first[1:], t.docs + len(doc)][: rows + 1], pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(np.r_[0, np.full(rows, t.docs)].astype(np.int32)), ids, mask=only_first),
                ], schema=_INDEX)
                block += 1

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, _INDEX_DDL), "blocks")


def item_terms(items: DataFrame, bundles: int) -> DataFrame:
    """(item, item_id, term, times, bundle) of numbered items."""
    folded = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = items.select("item", "item_id", F.explode(F.regexp_extract_all(folded, F.lit(PATTERN), F.lit(0))).alias("term"))
    return found.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn(
        "bundle", F.expr(f"CAST(pmod(xxhash64(item), {bundles}) AS int)")
    )


def _add(top: int | None):
    """One step of the pipeline: a state and an owner's postings to the next state, or, given
    ``top``, to the best documents (in ``ids``, with their scores) of each item."""

    def step(state: pa.Table, postings: pa.Table) -> pa.Table:
        if not len(state):  # an owner's postings for a block that no bundle visits
            return _STATE.empty_table()
        bundle, block = state["bundle"][0].as_py(), state["block"][0].as_py()
        norm = state.filter(pc.is_null(state["item"]))
        m, ids = norm["value"].combine_chunks().values.to_numpy(), norm["ids"].combine_chunks().values
        scores: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(m), dtype=np.int64))

        def arrays(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
            lists = column.combine_chunks()
            return lists.offsets.to_numpy(), lists.values.to_numpy()

        held = state.filter(pc.is_valid(state["item"]))
        (at, local), (_, value) = arrays(held["local"]), arrays(held["value"])
        for k, item in enumerate(held["item"].to_pylist()):
            scores[item][local[at[k] : at[k + 1]]] = value[at[k] : at[k + 1]]
        (at, local), (_, tf) = arrays(postings["local"]), arrays(postings["value"])
        (ask, items), (_, times) = arrays(postings["items"]), arrays(postings["times"])
        for k, w in enumerate(postings["w"].to_numpy()):
            docs, n = local[at[k] : at[k + 1]], tf[at[k] : at[k + 1]]
            gain = w * (1_000_000_000 * n // (1000 * n + 8 * m[docs]))
            for item, t in zip(items[ask[k] : ask[k + 1]].tolist(), times[ask[k] : ask[k + 1]].tolist()):
                scores[item][docs] += t * gain
        order = ids.fill_null(2**63 - 1).to_numpy()
        found, edges, local, value = [], [0], [], []
        for item, score in scores.items():
            hit = np.flatnonzero(score)
            if top is not None and len(hit) > top:
                least = np.partition(score[hit], len(hit) - top)[len(hit) - top]
                hit = hit[score[hit] >= least]
                hit = hit[np.lexsort((order[hit], -score[hit]))][:top]
            found.append(item)
            local.append(hit)
            value.append(score[hit])
            edges.append(edges[-1] + len(hit))
        none = np.zeros(0, dtype=np.int64)
        local, value, edges = np.concatenate([none, *local]), np.concatenate([none, *value]), np.array(edges)
        chosen = pa.nulls(len(found), pa.list_(pa.int64()))
        if top is not None:
            chosen = pa.ListArray.from_arrays(pa.array(edges, type=pa.int32()), ids.take(pa.array(local)))
        out = pa.table([
            pa.array([bundle] * len(found), type=pa.int32()), pa.array([block] * len(found), type=pa.int64()),
            pa.array(found, type=pa.int64()), _lists(local, edges, pa.int32()), _lists(value, edges, pa.int64()), chosen,
        ], schema=_STATE)
        return out if top is not None else pa.concat_tables([norm.cast(_STATE), out])

    return step


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item."""
    numbered = benchmark.select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    numbered = materialise(numbered, "items")
    bundles = math.ceil(max(numbered.count(), 1) / BUNDLE)
    items = materialise(item_terms(numbered, bundles), "item-terms")
    blocks = index(docs, wanted_bits(items))
    lengths = blocks.filter("term IS NULL")
    facts = lengths.agg(
        F.sum(F.size(F.filter("value", lambda n: n > 0))).alias("n"),
        F.sum(F.aggregate("value", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l"),
    ).first()
    n_docs, n_terms = facts["n"] or 0, facts["l"] or 0

    held = blocks.filter("term IS NOT NULL")
    df = held.groupBy("term").agg(F.sum(F.size("local")).alias("df"))
    asked = items.groupBy("bundle", "term").agg(F.sort_array(F.collect_list(F.struct("item", "times"))).alias("asked"))
    ratio = (2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    owner = sum((F.col("df") > F.lit(share * n_docs)).cast("int") for share in OWNERS)
    weighted = materialise(
        asked.join(df, "term").select(
            "bundle", "term", owner.alias("owner"), F.floor(1000 * F.log(ratio)).cast("long").alias("w"),
            F.col("asked.item").alias("items"), F.col("asked.times").alias("times"),
        ),
        "asked",
    )

    # Every bundle visits every block: the lengths are copied once for each bundle.
    norm = F.expr(f"transform(value, n -> {100 - LENGTH_WEIGHT}L + ({LENGTH_WEIGHT}L * n * {n_docs}L) div {max(n_terms, 1)}L)")
    state = lengths.select(
        F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"),
        "block", F.lit(None).cast("long").alias("item"), F.lit(None).cast("array<int>").alias("local"),
        norm.alias("value"), "ids",
    )
    for k in range(len(OWNERS) + 1):
        postings = held.join(weighted.filter(F.col("owner") == k), "term").select(
            "bundle", F.col("block").alias("block"), "w", "items", "times", "local", "value"
        )
        state = (
            state.groupBy("bundle", "block")
            .cogroup(postings.groupBy("bundle", "block"))
            .applyInArrow(_add(top if k == len(OWNERS) else None), _STATE_DDL)
        )
    best = state.select("item", F.explode(F.arrays_zip("ids", "value")).alias("x")).select(
        "item", F.col("x.ids").alias("doc_id"), F.col("x.value").alias("score")
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


_SQL = rf"""
WITH fold AS (
  SELECT row_number() OVER () AS r, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tokens AS (SELECT r, doc_id, unnest(regexp_extract_all(text, '{PATTERN}')) AS term FROM fold),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
size AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term, docs),
asked AS (
  SELECT q, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')) AS term
  FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)),
times AS (SELECT q, item_id, term, count(*) AS times FROM asked GROUP BY ALL),
score AS (
  SELECT q, item_id, r, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * ({100 - LENGTH_WEIGHT} + ({LENGTH_WEIGHT} * n * docs) // terms))))::BIGINT
           AS score
  FROM times JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (r), total GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""


@query("op12_ranked_search", _SQL)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
