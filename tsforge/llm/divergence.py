"""Source divergence audit: how far the sources of a language differ in their vocabulary.

Each language keeps the terms that enough of its documents hold. Every source of the language,
and the language as a whole, gives each kept term a smoothed share in integer billionths, and
two shares differ by ``f(p, q) = floor((p - q)**2 / (p + q))``. The sum of f over all kept terms
compares each source with each other one; single terms show what a source says unusually often.

Sums over all terms come from the terms that occur (Gustavson row accumulation): with ``p0`` the
share of a count of zero, and V kept terms,

    sum f(p, q) = V f(p0, q0) + sum over terms of p  [f(p, q0) - f(p0, q0)]
                              + sum over terms of q  [f(p0, q) - f(p0, q0)]
                              + sum over common terms [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

The last sum is a sparse row times the term-major index: a source scatters its terms through the
index of a block of terms into one dense accumulator over its peers, and only accumulators leave a
task. The middle sums need no more than how often a source has each share (``shares``), and every
source meets each block of ``PEERS`` peers once. Blocks of terms follow the size of the index and
blocks of peers the number of sources, so a language or a source with a third of all rows is many
tasks. Arithmetic is exact in 64 bits while a language has fewer than 2**48 tokens.

Defined results: null text, language or source count as ''. A language without kept terms gives
each pair the value 0 and no terms; a source alone in its language has no pairs. Every row is a
document, rows that repeat included. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsforge.llm import terms as tm
from tsforge.llm.base import materialise, query, table

MIN_DOCS, TOP = 10, 10
#: Text of one slice in bytes, partial rows held by a task, index entries of a block, sources of a block.
SLICE, HELD, ENTRIES, PEERS = 1 << 22, 400_000, 1 << 20, 1024


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d): occurrences of a term and documents that hold it; one row
    without a term for each source, so that sources without terms are known."""
    held: list[pa.Table] = []

    def combined() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.concat_tables(held)
            held.clear()
            rows = rows.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("d", "sum")])
            yield from rows.rename_columns(["lang", "source", "term", "n", "d"]).to_batches()

    for batch in batches:
        group = [batch.column(k).dictionary_encode() for k in (0, 1)]
        lang, source = (g.indices.to_numpy().astype(np.int64) for g in group)
        wide = max(len(group[1].dictionary), 1)

        def part(owner, names, n, d):
            return pa.table({
                "lang": group[0].dictionary.take(pa.array(owner // wide)),
                "source": group[1].dictionary.take(pa.array(owner % wide)),
                "term": names, "n": pa.array(n, type=pa.int64()), "d": pa.array(d, type=pa.int64()),
            })

        seen = np.unique(lang * wide + source)
        held.append(part(seen, pa.nulls(len(seen), pa.string()), seen * 0, seen * 0))
        for t in tm.slices(batch.column(2), tm.NOT_LETTER, SLICE):
            doc, term, n = t.counts()
            if len(doc):
                owner = (lang * wide + source)[t.first + doc]
                names = max(len(t.names), 1)
                key, at = np.unique(owner * names + term, return_inverse=True)
                total = np.zeros(len(key), dtype=np.int64)
                np.add.at(total, at, n)
                text = t.names.take(pa.array(key % names)).cast(pa.string())
                held.append(part(key // names, text, total, np.bincount(at, minlength=len(key))))
        if sum(len(rows) for rows in held) > HELD:
            yield from combined()
    yield from combined()


def source_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d), one row per term of a source and one without a term per source."""
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = read.mapInArrow(_count, "lang string, source string, term string, n long, d long")
    return materialise(
        partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "source-terms"
    )


def share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(10**9 (n + 2) / (total + 2 kept)); 10**9 = 31250 * 32000 keeps it in 64 bits."""
    part = f"({n} + 2) * 31250L"
    whole = f"({total} + 2 * {kept})"
    return F.expr(f"CASE WHEN {whole} = 0 THEN 1L ELSE 1L + ({part} div {whole}) * 32000L"
                  f" + ((({part}) % {whole}) * 32000L) div {whole} END")  # fmt: skip


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) of positive integers."""
    return (p - q) ** 2 // (p + q)


def index(counted: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(sources, entries), both written: ``lang, source, kept, blocks, block, p0`` and, for each kept
    term that a source has, ``lang, source, block, blocks, term, p, p0, q``, q the language's share."""
    used = counted.filter("term IS NOT NULL")
    kept = used.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("lang_n"))
    kept = materialise(kept.filter(F.col("d") >= min_docs).drop("d"), "kept-terms")
    own = used.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    own = materialise(own, "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    sources = counted.filter("term IS NULL").select("lang", "source")
    width = sources.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / PEERS).cast("int").alias("blocks"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = sources.join(width, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    facts = facts.na.fill(0, ["kept", "lang_total", "total"]).select(
        "lang", "source", "kept", "lang_total", "total", "blocks",
        F.expr("CAST(pmod(xxhash64(source), blocks) AS int)").alias("block"),
        share("0L", "total", "kept").alias("p0"),
    )
    facts = materialise(facts, "sources")
    entries = own.join(facts, ["lang", "source"]).select(
        "lang", "source", "block", "blocks", "term", "p0",
        share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q"),
    )
    return facts, materialise(entries, "entries")


def _meetings(rows: DataFrame) -> DataFrame:
    """A copy of each row for every block of peers it meets: (a, b) is a pair of blocks, a <= b;
    ``row`` and ``peer`` say on which side the copy stands (both, where a block meets itself)."""
    met = rows.withColumn("_other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return met.select(
        "*",
        F.least("block", "_other").alias("a"),
        F.greatest("block", "_other").alias("b"),
        (F.col("block") <= F.col("_other")).alias("row"),
        (F.col("block") >= F.col("_other")).alias("peer"),
    ).drop("_other")


def _sides(rows: pa.Table) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(rows of the side, sources of the side, source of each row) for row side and peer side."""
    for side in ("row", "peer"):
        at = np.flatnonzero(rows[side].to_numpy())
        coded = rows["source"].combine_chunks().take(pa.array(at)).dictionary_encode()
        yield at, coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _scatter(rows: pa.Table) -> pa.Table:
    """Sums over common terms of a block of terms, one row per pair of sources that share a term."""
    lang, a, b = (rows[c][0].as_py() for c in ("lang", "a", "b"))
    term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    p, p0 = rows["p"].to_numpy(), rows["p0"].to_numpy()
    (row_at, row_names, row), (peer_at, peer_names, peer) = _sides(rows)
    order = np.argsort(term[peer_at], kind="stable")
    peer_at, peer = peer_at[order], peer[order]
    edge = np.searchsorted(term[peer_at], np.arange(term.max() + 2))
    one, other, sums = [], [], []
    by_row = np.argsort(row, kind="stable")
    cut = np.searchsorted(row[by_row], np.arange(len(row_names) + 1))
    names = np.array(peer_names.to_pylist(), dtype=object)
    for r, name in enumerate(row_names.to_pylist()):
        mine = row_at[by_row[cut[r] : cut[r + 1]]]
        size = edge[term[mine] + 1] - edge[term[mine]]
        which = np.repeat(mine, size)
        at = np.arange(size.sum()) + np.repeat(edge[term[mine]] - (np.cumsum(size) - size), size)
        them = peer_at[at]
        gain = apart(p[which], p[them]) - apart(p[which], p0[them]) - apart(p0[which], p[them]) + apart(p0[which], p0[them])
        dense = np.zeros(len(names), dtype=np.int64)
        np.add.at(dense, peer[at], gain)
        hit = np.flatnonzero(dense)
        if a == b:
            hit = hit[names[hit] > name]
        one.append(pa.array([name] * len(hit), type=pa.string()))
        other.append(pa.array(names[hit].tolist(), type=pa.string()))
        sums.append(dense[hit])
    n = sum(map(len, sums))
    return pa.table({
        "lang": pa.array([lang] * n, type=pa.string()), "a": pa.array([a] * n, type=pa.int32()),
        "b": pa.array([b] * n, type=pa.int32()), "one": pa.chunked_array(one, type=pa.string()),
        "other": pa.chunked_array(other, type=pa.string()),
        "common": pa.array(np.concatenate(sums) if sums else [], type=pa.int64()),
    })


def _own(rows: pa.Table, at: np.ndarray, owner: np.ndarray, n: int, peers: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """For each source and each peer share of zero: the sum over the source's own terms."""
    p, k = rows["p"].to_numpy()[at], rows["k"].to_numpy()[at]
    out = np.zeros((n, len(peers)), dtype=np.int64)
    step = max(1, (1 << 20) // max(len(peers), 1))
    for lo in range(0, len(at), step):
        s = slice(lo, lo + step)
        less = apart(p0[owner[s], None], peers[None, :])
        np.add.at(out, owner[s], k[s, None] * (apart(p[s, None], peers[None, :]) - less))
    return out


def _finish(rows: pa.Table, common: pa.Table) -> pa.Table:
    """All pairs of a block of sources with a block of peers, in both directions."""
    lang, same = rows["lang"][0].as_py(), rows["a"][0].as_py() == rows["b"][0].as_py()
    kept = rows["kept"][0].as_py()
    zero = rows["p0"].to_numpy()
    (row_at, row_names, row), (peer_at, peer_names, peer) = _sides(rows)
    row0, peer0 = np.ones(len(row_names), dtype=np.int64), np.ones(len(peer_names), dtype=np.int64)
    row0[row], peer0[peer] = zero[row_at], zero[peer_at]
    value = kept * apart(row0[:, None], peer0[None, :])
    value += _own(rows, row_at, row, len(row0), peer0, row0)
    value += _own(rows, peer_at, peer, len(peer0), row0, peer0).T
    i = pc.index_in(common["one"].combine_chunks(), row_names).to_numpy(zero_copy_only=False)
    j = pc.index_in(common["other"].combine_chunks(), peer_names).to_numpy(zero_copy_only=False)
    np.add.at(value, (i.astype(np.int64), j.astype(np.int64)), common["common"].to_numpy())
    names = [np.array(x.to_pylist(), dtype=object) for x in (row_names, peer_names)]
    i, j = np.nonzero(names[0][:, None] < names[1][None, :]) if same else np.indices(value.shape).reshape(2, -1)
    one, other, value = names[0][i], names[1][j], value[i, j]
    return pa.table({
        "lang": pa.array([lang] * 2 * len(value), type=pa.string()),
        "source": pa.array(np.r_[one, other].tolist(), type=pa.string()),
        "item": pa.array(np.r_[other, one].tolist(), type=pa.string()),
        "value": pa.array(np.r_[value, value]),
    })


def pairs(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, source, item, value): each source with each other source of its language."""
    blocks = math.ceil(max(entries.count(), 1) / ENTRIES)
    dealt = entries.withColumn("terms", F.expr(f"pmod(xxhash64(term), {blocks})"))
    scattered = (
        _meetings(dealt.drop("q"))
        .groupBy("lang", "terms", "a", "b")
        .applyInArrow(_scatter, "lang string, a int, b int, one string, other string, common long")
    )
    common = scattered.groupBy("lang", "a", "b", "one", "other").agg(F.sum("common").alias("common"))
    shares = entries.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    facts = sources.select("lang", "source", "kept", "block", "blocks", "p0")
    # A share of zero with k = 0 stands for a source as such.
    shares = facts.join(shares, ["lang", "source"]).unionByName(
        facts.select("*", F.col("p0").alias("p"), F.lit(0).cast("long").alias("k"))
    )
    return (
        _meetings(shares)
        .groupBy("lang", "a", "b")
        .cogroup(common.groupBy("lang", "a", "b"))
        .applyInArrow(_finish, "lang string, source string, item string, value long")
    )


def unusual_terms(entries: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): terms a source has above its language, the ``top`` farthest."""
    above = entries.filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of all pairs and of the unusual terms."""
    sources, entries = index(source_terms(docs), min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs(sources, entries).withColumn("rank", F.row_number().over(order))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return (
        ranked.withColumn("part", F.lit("pair")).select(*columns)
        .unionByName(unusual_terms(entries, top).withColumn("part", F.lit("term")).select(*columns))
    )


_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN own USING (lang, source) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
         1 + ((1000000000::HUGEINT * (coalesce(o.n, 0) + 2)) // (g.total + 2 * l.v))::BIGINT AS p,
         1 + ((1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v))::BIGINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
single AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM grid WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM single))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""


@query("op13_source_divergence", _SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by language and source."""
    return audit(table(spark, sf_dir, "documents"))
