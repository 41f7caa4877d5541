"""Ordinal regression: held-out accuracy, severity order, awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tsforge.llm import ordinal

BAD = ["vilewort", "muckish", "dreckly", "foulmouth"]


def sample(n, seed):
    rng = random.Random(seed)
    common = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        w = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        toxic = rng.randint(1, 3) if rng.random() < 0.25 else 0
        if toxic:
            for _ in range(max(2, int(len(w) * (0.02, 0.05, 0.12)[toxic - 1]))):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "s", "ing"]))
        rows.append((k, " ".join(w), toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = sample(700, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return ordinal.fit_labelled(docs, labels)


def test_held_out(spark, model):
    rows = sample(500, 2)
    docs = spark.createDataFrame([(*r[:2], 1, 2) for r in rows], "doc_id long, text string, severity long, _judged long")
    out = {r["doc_id"]: r for r in ordinal.score(docs, model).collect()}
    right = [out[k]["toxic"] == bool(t) for k, _, t in rows]
    assert np.mean(right) > 0.97
    assert (np.diff(model.threshold) > 0).all() and len(model.threshold) == 3


def test_severity_grows_with_the_share(model):
    text = lambda n: " ".join(["w1", "w2"] * 50 + ["vilewort", "muckish"] * n)
    expected, grade = ordinal.severity(model, pa.array([text(n) for n in (0, 1, 4, 20)]))
    assert (np.diff(expected) > 0).all() and expected[0] < 0.2 and expected[-1] > 2 and grade[0] == 0


def test_odd_texts(make, model):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "VILEWORT!! muckish;" * 30_000), (None, "vilewort muckish"), (4, "w1 w2")]
    out = ordinal.score(make(rows), model).collect()
    assert len(out) == 6
    by = {(r["doc_id"], r["text"] is not None and len(r["text"])): r["toxic"] for r in out}
    assert not by[1, False] and not by[2, 0] and not by[3, 2] and by[None, 16] and not by[4, 5]
    assert ordinal.score(make([]), model).count() == 0


def test_without_toxic_labels_nothing_is_toxic(make):
    docs = make([(1, "a b"), (2, "c d")])
    for labels in ([], [(1, 0), (2, 0)], [(1, 1), (2, 1)], [(None, None)]):
        fitted = ordinal.fit_labelled(docs, make(labels, "doc_id long, toxic int"))
        assert [r["severity"] for r in ordinal.score(docs, fitted).collect()] == [0.0, 0.0]


def test_sample_is_bounded_and_stable(spark):
    rows = sample(300, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    a = ordinal.fit_labelled(docs, labels, 150)
    b = ordinal.fit_labelled(docs.repartition(7), labels.repartition(5), 150)
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.threshold, b.threshold)


def test_labels_of_two_grades_give_one_threshold(spark):
    rows = sample(400, 4)
    docs = spark.createDataFrame([r[:2] for r in rows] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2] > 0)) for r in rows], "doc_id long, toxic int")
    fitted = ordinal.fit_labelled(docs, labels)
    assert len(fitted.threshold) == 1
    expected, _ = ordinal.severity(fitted, pa.array([r[1] for r in rows]))
    assert ((expected >= 0) & (expected <= 1)).all()


def test_gradient_and_likelihood_against_brute_force(monkeypatch):
    monkeypatch.setattr(ordinal, "BLOCK", 7)
    rng = np.random.default_rng(1)
    n, width, top = 25, 6, 3
    size = rng.integers(0, 5, n)
    at = np.r_[0, np.cumsum(size)]
    col, x = rng.integers(0, width, at[-1]).astype(np.int32), rng.random(at[-1]).astype(np.float32)
    grade = rng.integers(0, top + 1, n)
    p = rng.normal(size=width + top) * 0.5

    def plain(p):
        t = [p[width]]
        for gap in p[width + 1 :]:
            t.append(t[-1] + np.exp(gap))
        total = 0.0
        for i in range(n):
            eta = sum(p[c] * v for c, v in zip(col[at[i] : at[i + 1]], x[at[i] : at[i + 1]]))
            above = [1.0, *(1 / (1 + np.exp(k - eta)) for k in t), 0.0]
            total += np.log(above[grade[i]] - above[grade[i] + 1])
        return total / n - 0.005 * (p[:width] ** 2).sum()

    got, slope = ordinal.likelihood(p, at, col, x, grade, width, 0.01)
    assert np.isclose(got, plain(p))
    for k in range(len(p)):
        step = np.eye(len(p))[k] * 1e-5
        assert np.isclose(slope[k], (plain(p + step) - plain(p - step)) / 2e-5, atol=1e-6)


def test_features_do_not_depend_on_slices(corpus):
    column = pa.array([t for _, t in corpus])
    model = ordinal.Model(np.random.default_rng(2).normal(size=ordinal.WIDTH), np.array([0.5, 2.0]))
    whole, _ = ordinal.severity(model, column)
    alone = [ordinal.severity(model, pa.array([t], type=pa.string()))[0][0] for _, t in corpus]
    assert np.allclose(whole, alone)
