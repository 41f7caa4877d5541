import numpy as np
import pytest
from pyspark.sql import functions as F

from tsforge.operators import evaluate as e
from tsforge.operators import models as m
from tsforge.operators import windows as w


@pytest.fixture()
def windows(spark, hours):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=24 * 120)
    df = hours("2024-01-01", 24 * 120, lambda i: float(50 + 10 * np.sin(i / 24 * 2 * np.pi) + noise[i]))
    return w.make_windows(df, ["series"], "ts", ["value"], ["value"], "value")


def test_ar_equals_closed_form_least_squares(windows):
    rows = windows.collect()
    x = np.array([[h.value for h in r.past][-12:] for r in rows])
    y = np.array([r.y for r in rows])
    one = np.hstack([x, np.ones((len(x), 1))])
    want = np.linalg.lstsq(one, y, rcond=None)[0]
    got = m.ar_fit(windows.repartition(7), "value", lags=12, ridge=0.0)
    assert np.allclose(got.weights, want[:-1], atol=1e-5) and np.allclose(got.bias, want[-1], atol=1e-3)


def test_ar_with_all_lags_beats_the_mean(windows):
    scored = m.ar_mimo(windows, windows, "value")
    hours = w.stack_hours(scored, ["anchor"], ["y", "predicted"])
    row = e.rmse_mae(hours).first()
    assert row.rmse < hours.agg(F.stddev_pop("y")).first()[0]


def test_scoring_inverse_and_rounding(spark):
    df = spark.createDataFrame([([1.0, -1.0],), ([0.5, 2.0],)], "x ARRAY<DOUBLE>")
    model = m.LinearForecast(np.eye(2), np.zeros(2))
    got = m.score_windows(df, model, F.col("x"), inverse="signed_exp", rounded=True)
    assert sorted(r.predicted for r in got.collect()) == [[0.65, 6.39], [1.72, -1.72]]
    with pytest.raises(ValueError):
        m.score_windows(df, model, F.col("x"), inverse="nope")


def test_gate(spark):
    df = spark.createDataFrame([(2.0, 4.0, 0.0), (2.0, 4.0, 50.0)], "a DOUBLE, b DOUBLE, l DOUBLE")
    assert [r.blended for r in m.gated_blend(df, "a", "b", "l").collect()] == pytest.approx([3.0, 2.0])
    arrays = df.select(F.array("a", "b").alias("a"), F.array("b", "a").alias("b"), "l")
    assert m.gated_blend(arrays, "a", "b", "l").first().blended == [3.0, 3.0]


def test_ablation_ranks_the_features(spark):
    df = spark.range(400).select(
        (F.col("id") % 20).cast("double").alias("strong"), (F.col("id") % 7).cast("double").alias("weak")
    ).withColumn("y", F.col("strong") * 3 + F.col("weak") * 0.1)
    model = m.LinearForecast(np.array([3.0, 0.1]), np.zeros(()))
    got = {r.feature: r for r in m.mean_ablation(df.repartition(5), ["strong", "weak"], "y", model).collect()}
    assert got["strong"].base_rmse == pytest.approx(0, abs=1e-9)
    strong = np.array([i % 20 for i in range(400)], dtype=float)
    assert got["strong"].change == pytest.approx(3 * strong.std()) and got["weak"].change < got["strong"].change


def test_trees_learn_and_search_is_seeded(spark):
    df = spark.range(300).select((F.col("id") % 10).cast("double").alias("x"), F.pmod("id", F.lit(3)).cast("int").alias("fold"))
    df = df.withColumn("y", F.when(F.col("x") > 4, 10.0).otherwise(0.0))
    got = m.gbt_fit_predict(df, df, ["x"], "y", depth=2, rounds=3)
    assert got.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-6
    holes = df.withColumn("x", F.when(F.col("x") != 7, F.col("x")))
    assert m.gbt_fit_predict(holes, holes, ["x"], "y", depth=2, rounds=3).where("prediction IS NOT NULL").count() == 300
    space = {**m.SEARCH_SPACE, "maxDepth": (1, 2, "int"), "maxIter": (1, 2, "int")}
    best, scores = m.random_search(df, ["x"], "y", folds=3, draws=2, space=space)
    assert scores.count() == 2 and scores.where("best").count() == 1
    assert m.draw_parameters(20) == m.draw_parameters(20) and len(m.draw_parameters(20)) == 20


def test_metrics_on_awkward_actuals(spark):
    rows = [(1, 1.0, 0.0), (1, 2.0, None), (1, 3.0, -5.0), (2, 1.0, None)]
    df = spark.createDataFrame(rows, "k INT, predicted DOUBLE, actual DOUBLE")
    got = e.paired_stats(df, ["k"]).collect()
    assert len(got) == 1 and got[0].avg_predicted == 2.0 and got[0].avg_actual == -2.5
    assert got[0].mae == 4.5 and got[0].rmse == pytest.approx((65 / 2) ** 0.5)
    raw = e.mape_raw(df, "actual").first()
    assert raw.excluded == 1 and raw.mape == pytest.approx(160.0)
    assert e.mape_safe(df, "actual").first().mape == pytest.approx((1.0 / 1e-6 + 1.6) / 2 * 100)
    assert e.max_signed_error(df, "actual").first().max_error == 8.0


def test_profile_error_hides_offsetting_errors(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 2.0), (1, 5.0, 5.0)], "hour INT, y DOUBLE, predicted DOUBLE")
    row = e.profile_error(df).first()
    assert (row.rmse, row.mae) == (0.0, 0.0) and e.rmse_mae(df).first().mae > 0


def test_fold_means_are_unweighted(spark):
    df = spark.createDataFrame([(1, "val", 0.0, 1.0), (2, "val", 0.0, 3.0), (2, "val", 0.0, 3.0)], "fold INT, split STRING, y DOUBLE, predicted DOUBLE")
    assert e.fold_mean(e.fold_scores(df)).first().mae == 2.0


def test_ablation_uses_the_mean_of_the_scored_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (100.0, None), (None, 5.0)], "x DOUBLE, y DOUBLE")
    row = m.mean_ablation(df, ["x"], "y", m.LinearForecast(np.ones(1), np.zeros(()))).first()
    assert (row.base_rmse, row.ablated_rmse, row.scored, row.left_out) == (0.0, 1.0, 2, 2)


def test_draws_are_the_same_in_python_and_in_a_table(spark):
    names = list(m.SEARCH_SPACE)
    seeds = spark.createDataFrame([("0",), ("view",), ("view",)], "seed STRING")
    got = m.draw_table(seeds, "seed", 20).collect()
    assert len(got) == 40
    for r in got:
        one = m.draw_parameters(20, r.seed)[r.draw]
        assert [r[n] for n in names] == pytest.approx([one[n] for n in names])
        assert all(lo <= r[n] <= hi for n, (lo, hi, _) in m.SEARCH_SPACE.items())
    assert len({tuple(r[n] for n in names) for r in got}) == 40
