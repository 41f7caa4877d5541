"""Quality rules: per-document base rules, and lines that many documents of a host share.

Lines are normalised (A-Z folded, white space collapsed) and hashed; for each host the distinct
documents that hold a line are counted. A line in more than ``MAX_DOCS`` documents of a host
is removed from that host's documents, and a document that loses more than ``MAX_LOSS`` percent of
its words is depleted and rejected. ``clean`` writes the text without those lines; the query
reports the verdicts.

Defined results: null text has no words and fails the base rule; a null host is a host of its
own; a row without a document id counts as no document; rows that repeat an id are one document in the
counts and each get a verdict. Empty tables give empty results, extra columns are ignored,
and texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import text as tx
from tsforge.llm.base import materialise, query, table

MAX_DOCS, MAX_LOSS, MIN_WORDS, MAX_REPEAT = 20, 50, 10, 20
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_KIND = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))]
)
_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<struct<line: long, words: long>>"
)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set flags in each range between offsets."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every ``\\n``-split line; a text of n breaks has n + 1 lines."""
    breaks = np.flatnonzero(raw == 0x0A)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    doc = np.concatenate([np.arange(len(offsets) - 1), owner])
    begin = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    end_doc = np.concatenate([owner, np.arange(len(offsets) - 1)])
    first, last = np.lexsort((begin, doc)), np.lexsort((end, end_doc))
    return begin[first], end[last], doc[first]


def normal_lines(raw: np.ndarray, w: tx.Words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the normalised line, its words) for each line."""
    h = tx.word_hashes(raw, w, lower=True)
    first, last = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    return tx.sequence_hashes(h, first, last), last - first


def repeated(h: np.ndarray, w: tx.Words, docs: int, n: int = 5) -> np.ndarray:
    """Words of each text that lie in an ``n``-word window found twice or more in it."""
    g, at = tx.grams(h, w, n)
    if not len(g):
        return np.zeros(docs, dtype=np.int64)
    key = tx.mix(g ^ (w.doc[at].astype(np.uint64) * tx.BASE))
    order = np.argsort(key, kind="stable")
    same = np.r_[False, key[order][1:] == key[order][:-1]]
    same[:-1] |= same[1:]
    start = at[order[same]]
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + n, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return np.bincount(w.doc[covered], minlength=docs)


def _measure(column: pa.Array) -> pa.Array:
    parts = {name: [] for name in _KIND.names[:-1]}
    line_hash, line_words, lengths = [], [], []
    for _, raw, offsets in tx.slices(column):
        docs = len(offsets) - 1
        w = tx.words(raw, offsets)
        h = tx.word_hashes(raw, w)
        inside = ~tx._SEPARATOR[raw]
        begin, end, doc = lines_of(raw, offsets)
        normal, n = normal_lines(raw, w, begin, end)
        used = n > 0
        normal, n, doc = normal[used], n[used], doc[used]
        exact = tx.span_hashes(raw, begin[used], end[used])
        per_doc = np.bincount(doc, minlength=docs)
        _, first = np.unique(tx.mix(exact ^ (doc.astype(np.uint64) * tx.BASE)), return_index=True)
        parts["n_words"].append(w.count)
        parts["word_chars"].append(_sums(inside & ((raw & 0xC0) != 0x80), offsets))
        parts["n_symbols"].append(_sums(_SYMBOL[raw], offsets))
        parts["n_dup_lines"].append(per_doc - np.bincount(doc[first], minlength=docs))
        parts["n_repeat_words"].append(repeated(h, w, docs))
        order = np.lexsort((normal, doc))
        normal, n, doc = normal[order], n[order], doc[order]
        fresh = np.flatnonzero(np.r_[True, (normal[1:] != normal[:-1]) | (doc[1:] != doc[:-1])][: len(doc)])
        line_hash.append(normal[fresh].view(np.int64))
        line_words.append(np.add.reduceat(n, fresh) if len(fresh) else n)
        lengths.append(np.bincount(doc[fresh], minlength=docs))
    none = np.zeros(0, dtype=np.int64)
    cat = lambda arrays: np.concatenate(arrays) if arrays else none
    flat = pa.StructArray.from_arrays(
        [pa.array(cat(line_hash)), pa.array(cat(line_words))], fields=list(_KIND.field("lines").type.value_type)
    )
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cat(lengths))].astype(np.int32)), flat)
    return pa.StructArray.from_arrays(
        [pa.array(cat(parts[n]).astype(np.int64)) for n in _KIND.names[:-1]] + [lists], fields=list(_KIND)
    )


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, host, base figures, lines), one row per document and with a row number, written."""
    measured = F.arrow_udf(_measure, _DDL)
    figures = docs.select(F.col("doc_id"), F.col("source").alias("host"), measured("text").alias("m"))
    return materialise(
        figures.select("doc_id", "host", "m.*").withColumn("_row", F.monotonically_increasing_id()), "figures"
    )


def common_lines(figures: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line) in more than ``max_docs`` distinct documents of the host."""
    lines = figures.select("doc_id", "host", F.explode("lines.line").alias("line"))
    held = lines.groupBy("host", "line").agg(F.count_distinct("doc_id").alias("n_docs"))
    return held.filter(F.col("n_docs") > max_docs).select("host", "line")


def verdicts(figures: DataFrame, max_docs: int = MAX_DOCS, max_loss: int = MAX_LOSS) -> DataFrame:
    """``figures`` with removed_words, base_failed, depleted and kept."""
    common = common_lines(figures, max_docs).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    lines = figures.select("_row", "host", F.inline("lines"))
    lost = lines.join(common, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")))
    lost = lost.groupBy("_row").agg(F.sum("words").alias("removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = figures.drop("lines").join(lost, "_row", "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    out = out.withColumn("depleted", 100 * F.col("removed_words") > max_loss * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("depleted"))


_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
lines AS (
  SELECT r, doc_id, source, line,
         list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
  FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs)),
used AS (SELECT r, doc_id, source, line, len(lw) AS n, array_to_string(lw, ' ') AS normal FROM lines WHERE len(lw) > 0),
common AS (SELECT source, normal FROM used GROUP BY ALL HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
lost AS (
  SELECT r, sum(n) AS removed FROM used JOIN common
    ON used.source IS NOT DISTINCT FROM common.source AND used.normal = common.normal GROUP BY r),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM used GROUP BY r),
grams AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM docs)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY r),
base AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         coalesce(removed, 0)::BIGINT AS removed_words
  FROM docs LEFT JOIN dups USING (r) LEFT JOIN cover USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words
            OR 100 * removed_words > {MAX_LOSS} * n_words) AS kept
FROM base"""


@query("op6_line_frequency", _SQL)
def line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document; the host of a document is its source."""
    judged = verdicts(measure(table(spark, sf_dir, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept"
    )
