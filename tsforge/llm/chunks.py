"""Substring deduplication by content-defined chunking with a gear hash.

The gear hash of the last 16 bytes decides where a chunk ends, so an insertion moves only the
chunks it touches. Chunks (32 bytes on average) are deduplicated by a 64-bit digest: the document
with the smallest id keeps a chunk, later ones lose it, as does a document that repeats itself.
Single chunks are too short to mean anything, so only runs of duplicate chunks that hold at
least ``MIN_WORDS`` whole words are cut out, from word to word. A digest collision alone never
removes text: a run needs several equal digests in a row.

Defined results: null and empty texts have no chunks and stay as they are. A row without an id
is ordered by a hash of its text. Rows that repeat an id are one document: they keep or lose the
same chunks. Other columns are kept (one
named like an output column is replaced); ``n_chars`` is not touched here. Texts of any length are read
whole. A chunk of more than ``LONGEST`` bytes (text that repeats a few bytes over and over) is cut by a
second, looser mask of the same hash, where the hash is the lowest for ``SPACING`` bytes around, so that an
insertion moves only the chunks it touches there too; where even that finds no boundary (a period shorter
than ``SPACING``) the chunk stays whole. No cut depends on an offset.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import text as tx
from tsforge.llm.base import materialise, query, table

MIN_WORDS, WINDOW, SPACING, LONGEST = 16, 16, 8, 1024
#: A position ends a chunk when its 16-bit hash is below this: once in 32 bytes.
BELOW = np.uint16((1 << 16) // 32)
#: Inside a long chunk, when it is below this: once in 4 bytes.
LOOSELY = np.uint16((1 << 16) // 4)
GEAR = (tx.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def gear(raw: np.ndarray) -> np.ndarray:
    """16-bit gear hash of the ``WINDOW`` bytes up to each position: the sum of G[b] << age."""
    h = GEAR[raw]
    span = 1
    while span < WINDOW:
        older = h[:-span] << np.uint16(span)
        h = h.copy()
        h[span:] += older
        span *= 2
    return h


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every chunk of the texts of a slice."""
    doc_begin = offsets[:-1]
    hashes = gear(raw)
    cut = np.flatnonzero(hashes < BELOW) + 1
    # Where the window would reach into the text before, there is no boundary.
    doc = np.searchsorted(offsets, cut - 1, side="right") - 1
    cut = cut[cut - doc_begin[doc] >= WINDOW]
    # A boundary close behind another is none.
    cut = cut[np.r_[True, np.diff(cut) >= SPACING][: len(cut)]]
    begin = np.union1d(cut, doc_begin)
    begin = begin[begin < offsets[-1]]
    end = np.r_[begin[1:], offsets[-1:]]
    loose = [_loose_cuts(hashes, a, b) for a, b in zip(begin[end - begin > LONGEST], end[end - begin > LONGEST])]
    if loose:
        begin = np.union1d(begin, np.concatenate(loose))
        end = np.r_[begin[1:], offsets[-1:]]
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def _loose_cuts(hashes: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Boundaries by the looser mask inside one chunk: below it, and the lowest for ``SPACING`` bytes on both sides."""
    h = hashes[begin + WINDOW - 1 : end - 1].astype(np.int64)
    lowest = h < LOOSELY
    for k in range(1, min(SPACING, len(h))):
        lowest[k:] &= h[k:] < h[:-k]
        lowest[:-k] &= h[:-k] <= h[k:]
    return begin + WINDOW + np.flatnonzero(lowest)


def _per_text(digest: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of each text, as (digests, offsets)."""
    digest = digest.copy()
    edges = np.searchsorted(doc, np.arange(docs + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        digest[a:b].sort()
    fresh = np.r_[True, (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1])][: len(doc)]
    return digest[fresh], np.searchsorted(doc[fresh], np.arange(docs + 1))


def _digests(column: pa.Array) -> pa.Array:
    values, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for _, raw, offsets in tx.slices(column):
        begin, end, doc = chunks(raw, offsets)
        distinct, at = _per_text(tx.span_hashes(raw, begin, end), doc, len(offsets) - 1)
        values.append(distinct)
        counts.append(np.diff(at))
    edges = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(values).view(np.int64)))


def _rewrite(raw: np.ndarray, known: np.ndarray, min_words: int) -> tuple[bytes, int]:
    """(text without duplicate runs, words removed) of one text; ``known`` are digests kept elsewhere."""
    offsets = np.array([0, len(raw)])
    begin, end, _ = chunks(raw, offsets)
    digest = tx.span_hashes(raw, begin, end)
    _, first = np.unique(digest, return_index=True)
    twice = np.ones(len(digest), dtype=bool)
    twice[first] = False
    twice |= np.isin(digest, known)
    if not twice.any():
        return raw.tobytes(), 0
    step = np.flatnonzero(np.diff(np.r_[0, twice.astype(np.int8), 0]))
    run_begin, run_end = begin[step[::2]], end[step[1::2] - 1]
    w = tx.words(raw, offsets)
    i, j = np.searchsorted(w.start, run_begin), np.searchsorted(w.end, run_end, side="right")
    long = j - i >= min_words
    if not long.any():
        return raw.tobytes(), 0
    keep = np.ones(len(raw), dtype=bool)
    for a, b in zip(i[long].tolist(), j[long].tolist()):
        keep[w.start[a] : w.start[b] if b < len(w.start) else w.end[b - 1]] = False
    return raw[keep].tobytes(), int((j - i)[long].sum())


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text cut and ``removed_words``."""
    digests = F.arrow_udf(_digests, "array<long>")
    order = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    held = docs.select(order.alias("key"), F.explode(digests("text")).alias("digest"))
    span = held.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # Written, so that both sides of the join are dealt anew and a digest that very many
    # documents hold can be split.
    shared = materialise(span.filter("first < last").select("digest", "first"), "shared")
    lost = held.join(shared, "digest").filter(F.col("key") > F.col("first"))
    lost = lost.groupBy(F.col("key").alias("_key")).agg(F.collect_set("digest").alias("_known"))

    kind = pa.struct([("text", pa.string()), ("removed", pa.int64())])

    @F.arrow_udf("text string, removed long")
    def rewrite(column: pa.Array, known: pa.Array) -> pa.Array:
        text, removed = [], []
        for value, digests_ in zip(column, known):
            if not value.is_valid:
                text.append(None)
                removed.append(0)
                continue
            raw = np.frombuffer(value.as_buffer(), dtype=np.uint8)
            have = digests_.values.to_numpy().view(np.uint64) if digests_.is_valid else np.zeros(0, dtype=np.uint64)
            out, n = _rewrite(raw, have, min_words) if len(raw) else (b"", 0)
            text.append(out.decode())
            removed.append(n)
        return pa.StructArray.from_arrays([pa.array(text, type=pa.string()), pa.array(removed, type=pa.int64())], fields=list(kind))

    whole = docs.select(F.struct("*").alias("_row"), order.alias("_key"))
    joined = whole.join(lost, "_key", "left").withColumn("_new", rewrite("_row.text", "_known"))
    columns = [F.col("_new.text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c != "removed_words"]
    return joined.select(*columns, F.col("_new.removed").alias("removed_words"))


@query("op7_chunk_dedup")
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the passages cut out that an earlier document holds."""
    out = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "removed_words", (F.col("removed_words") > 0).alias("changed"))
