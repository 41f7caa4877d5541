import numpy as np
import pytest

from tsforge.operators import crossval as c


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 4)) * [1.0, 50.0, 0.01, 3.0] + [0.0, 400.0, 5.0, -2.0]
    y = x @ rng.normal(size=(4, 3)) + rng.normal(size=(700, 3)) + [10.0, -300.0, 0.0]
    return np.arange(700) // 100 % 5, x, y


def _frame(spark, fold, x, y):
    rows = [(int(f), a.tolist(), b.tolist()) for f, a, b in zip(fold, x, y)]
    return spark.createDataFrame(rows, "fold INT, x ARRAY<DOUBLE>, y ARRAY<DOUBLE>").repartition(5)


def test_fits_and_scores_equal_one_fit_per_fold(spark, data):
    fold, x, y = data
    fits, scores = c.cross_validate(_frame(spark, fold, x, y), 4, 3)
    fits = {r.fold: r for r in fits.collect()}
    scores = {(r.fold, r.split): r for r in scores.collect()}
    assert set(fits) == set(range(5)) and len(scores) == 10
    for k in range(5):
        train, val = fold != k, fold == k
        one = np.hstack([x, np.ones((700, 1))])
        beta = np.linalg.lstsq(one[train], y[train], rcond=None)[0]
        assert np.allclose(fits[k].x_mean, x[train].mean(axis=0)) and np.allclose(fits[k].x_scale, x[train].std(axis=0))
        for split, at in (("train", train), ("val", val)):
            e = y[at] - one[at] @ beta
            got = scores[k, split]
            assert got.rows == at.sum() == fits[k][f"{split}_rows"]
            assert got.mse == pytest.approx((e**2).mean()) and got.rmse == pytest.approx(np.sqrt((e**2).mean()))
            assert got.mae == pytest.approx(np.abs(e).mean())
            assert fits[k][f"{split}_mse"] == pytest.approx((e**2).mean(), rel=1e-6)


def test_missing_values_take_no_part(spark, data):
    fold, x, y = data
    rows = _frame(spark, fold, x, y)
    holes = spark.createDataFrame(
        [(0, [1.0, None, 1.0, 1.0], [0.0] * 3), (1, [1.0] * 4, [float("nan"), 0.0, 0.0]), (None, [1.0] * 4, [0.0] * 3), (2, None, None)],
        "fold INT, x ARRAY<DOUBLE>, y ARRAY<DOUBLE>",
    )
    want = c.cross_validate(rows, 4, 3)[1]
    got = c.cross_validate(rows.unionByName(holes), 4, 3)[1]
    key = lambda df: sorted((r.fold, r.split, r.rows, round(r.mae, 9)) for r in df.collect())
    assert key(got) == key(want)


def test_constant_inputs_one_fold_and_nothing(spark, data):
    fold, x, y = data
    flat = np.hstack([np.full((700, 1), 7.0), x[:, :1]])
    fits, scores = c.cross_validate(_frame(spark, fold, flat, y[:, :1]), 2)
    assert all(r.x_scale[0] == 1.0 and abs(r.weights[0][0]) < 1e-9 for r in fits.collect())
    single = c.cross_validate(_frame(spark, fold * 0, x, y), 4, 3)
    assert single[0].count() == 0 and single[1].count() == 0
    empty = _frame(spark, fold[:1], x[:1], y[:1]).where("false")
    assert [df.count() for df in c.cross_validate(empty, 4, 3)] == [0, 0]


def test_rows_are_not_multiplied(spark, data):
    plan = c.fold_errors(_frame(spark, *data), c.fold_fits(c.fold_moments(_frame(spark, *data), 4, 3), 4, 3), 4, 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and text.count("Exchange hashpartitioning(fold") == 1
