from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsforge.operators import scaling as n
from tsforge.operators import windows as w


def test_population_deviation_and_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    fit = {r.feature: (r.mean, r.scale) for r in n.standard_fit(df, ["a", "b"]).collect()}
    assert fit["a"] == pytest.approx((2.0, (2 / 3) ** 0.5)) and fit["b"] == (5.0, 1.0)
    z = n.standard_apply(df, n.standard_fit(df, ["a", "b"]), ["a", "b"]).collect()
    assert [r.b for r in z] == [0.0] * 3 and z[0].a == pytest.approx(-1.5**0.5)


def test_an_hour_counts_once_per_window(spark, hours):
    df = hours("2023-12-31 23:00:00", 24 * 17 + 1, lambda i: float(i * i))
    windows = w.make_windows(df, ["series"], "ts", ["value"], ["value"], "value")
    assert windows.count() == 10
    all_hours = np.concatenate([[x.value for x in r.past] for r in windows.collect()])
    got = n.standard_fit_windows(windows, "past", ["value"]).first()
    assert (got["mean"], got["scale"]) == pytest.approx((all_hours.mean(), all_hours.std()))
    single = n.standard_fit(df, ["value"]).first()
    assert got["mean"] != pytest.approx(single["mean"])
    scaled = n.standard_apply_windows(windows, "past", n.standard_fit_windows(windows, "past", ["value"]), ["value"])
    z = np.concatenate([[x.value for x in r.past] for r in scaled.collect()])
    assert z.mean() == pytest.approx(0, abs=1e-9) and z.std() == pytest.approx(1)


def test_target_round_trip_and_reload(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0, 3.5],), ([-4.0, 0.0, 9.0],)], "y ARRAY<DOUBLE>")
    params = n.target_fit(df)
    n.save_scaler(params, str(tmp_path / "s"))
    loaded = n.load_scaler(spark, str(tmp_path / "s"))
    back = n.target_unscale(n.target_scale(df, params), loaded)
    assert np.allclose(sorted(r.y for r in back.collect()), sorted(r.y for r in df.collect()))


def test_passthrough_equals_impute_then_scale(spark):
    df = spark.createDataFrame([(1.0, 0.1), (None, 0.2), (4.0, 0.3), (7.0, 0.4)], "x DOUBLE, Day_sin DOUBLE")
    got = [r.x for r in n.scale_passthrough(df, ["x", "Day_sin"]).orderBy("Day_sin").collect()]
    x = np.array([1.0, 4.0, 4.0, 7.0])
    assert np.allclose(got, (x - x.mean()) / x.std())
    assert [r.x for r in n.impute_mean(df, ["x"]).orderBy("Day_sin").collect()] == [1.0, 4.0, 4.0, 7.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=200), st.sampled_from([10, 100, 10000]))
def test_quantiles_are_exact_even_with_a_coarse_sketch(spark, values, accuracy):
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    got = n.exact_quantiles(df, ["x"], (0.1, 0.25, 0.5, 0.75), accuracy)["x"]
    assert np.allclose(got, np.quantile(values, [0.1, 0.25, 0.5, 0.75]), rtol=1e-9, atol=1e-9)


def test_quantiles_of_many_rows_half_of_them_equal(spark):
    df = spark.range(40000).select(
        F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(100000)) / 1000.0).alias("x"),
        F.lit(None).cast("double").alias("none"),
    )
    x = np.array([r.x for r in df.collect()])
    got = n.exact_quantiles(df, ["x", "none"], (0.01, 0.25, 0.5, 0.9), 50)
    assert np.allclose(got["x"], np.quantile(x, [0.01, 0.25, 0.5, 0.9])) and got["none"] == [None] * 4


def test_parts_are_fitted_in_one_pass_as_one_by_one(spark):
    rows = [("t", [(1.0, 2.0), (3.0, None)], [(5.0, 0.0)], [1.0, 4.0]), ("t", [(2.0, 2.0)], [(5.0, 7.0), (5.0, 1.0)], []), ("v", [(9.0, 9.0)], [], [2.0])]
    df = spark.createDataFrame(rows, "split STRING, past ARRAY<STRUCT<a: DOUBLE, b: DOUBLE>>, future ARRAY<STRUCT<a: DOUBLE, c: DOUBLE>>, y ARRAY<DOUBLE>")
    got = n.standard_fit_parts(df, {"past": ["a", "b"], "future": ["a", "c"], "y": None}, ["split"])
    key = lambda part, r: (part, r.split, r.feature, r["mean"], r["scale"])
    want = [key("past", r) for r in n.standard_fit_windows(df, "past", ["a", "b"], ["split"]).collect()]
    want += [key("future", r) for r in n.standard_fit_windows(df, "future", ["a", "c"], ["split"]).collect()]
    want += [key("y", r) for r in n.target_fit(df, keys=["split"]).collect()]
    have = {k[:3]: k[3:] for k in (key(r.part, r) for r in got.collect())}
    for *name, mean, scale in want:
        assert have[tuple(name)] == pytest.approx((mean, scale))
    assert "Exchange hashpartitioning(split" in got._jdf.queryExecution().executedPlan().toString()
