from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsforge.operators import models as m
from tsforge.plans import dataset as d
from tsforge.sources import io


@pytest.fixture(scope="module")
def market(spark):
    """Two hundred days of a small market, with a few holes."""
    first = datetime(2023, 9, 1)
    h = F.col("id")
    wave = F.sin(h / 24 * 2 * np.pi)
    hole = lambda n, c: F.when(h % n != n - 1, c)
    return spark.range(24 * 200).select(
        (F.lit(first).cast("timestamp") + F.make_dt_interval(hours=h.cast("int"))).alias("ts"),
        hole(411, 50 + 10 * wave).alias("FR_price"),
        (40 + 5 * wave).alias("DE_price"),
        hole(503, 1000 + wave).alias("FR_Load_forecast"),
        hole(299, F.abs(wave)).alias("FR_Solar_forecast"),
        F.lit(None).cast("double").alias("FR_Wind_Offshore_forecast"),
        (wave * 3).alias("FR_DE_flow"),
    )


def test_calendar_dataset_to_predictions(spark, market, tmp_path):
    months = market.select(F.date_format("ts", "yyyy-MM").alias("Month")).distinct().where("Month <> '2023-11'")
    fuel = months.select("Month", F.lit(70.0).alias("EUA_EUR"), F.month(F.to_date("Month", "yyyy-MM")).cast("double").alias("TTF_EUR"), F.lit(5.0).alias("ARA_EUR"))
    rows = d.build_features(market, fuel)
    assert rows.where("TTF_EUR is null").count() == 0
    # November (local) has no price: the last one known is October's.
    assert {r[0] for r in rows.where("month(ts) = 11 and day(ts) < 30").select("TTF_EUR").distinct().collect()} == {10.0}

    made = d.build_dataset(rows, str(tmp_path / "set"), "calendar", scale_target=True)
    raw, scaled = spark.read.parquet(made.windows), spark.read.parquet(made.scaled)
    assert {r.split for r in raw.select("split").distinct().collect()} == {"train", "val"}
    assert raw.count() == scaled.count() > 100
    train = scaled.where("split = 'train'").select(F.explode("past").alias("h")).select(F.avg("h.FR_price"), F.stddev_pop("h.FR_price")).first()
    assert train[0] == pytest.approx(0, abs=1e-9) and train[1] == pytest.approx(1)
    roles = io.read_manifest(spark, made.manifest)
    assert roles["target_col"] == "FR_price" and "FR_price" not in roles["future_cols"] and "Day_sin" in roles["future_cols"]

    requests = spark.createDataFrame([(datetime(2024, 2, 1, 23),), (datetime(2019, 1, 1, 23),)], "target_date TIMESTAMP")
    model = m.LinearForecast(np.zeros((168, 24)), np.arange(24.0))
    answered = d.predict(spark, requests, rows, model, made)
    by_status = {r.status: r for r in answered.collect()}
    mean, std = raw.where("split = 'train'").select(F.explode("y").alias("y")).select(F.avg("y"), F.stddev_pop("y")).first()
    assert by_status["ok"].predicted == pytest.approx(list(np.arange(24.0) * std + mean), abs=0.005)
    assert by_status["no_data"].predicted is None
    stats = d.prediction_stats(answered).first()
    assert stats.avg_predicted == pytest.approx(11.5 * std + mean, abs=0.01) and stats.rmse > 0
    with pytest.raises(ValueError):
        d.predict(spark, requests, rows, model, made, fold=1)


def test_folds_are_scaled_by_their_own_training_part(spark, market, tmp_path):
    rows = d.build_features(market)
    made = d.build_dataset(rows, str(tmp_path / "folds"), "folds", scale_target=True)
    scalers = spark.read.parquet(made.past_scaler)
    assert {r.fold for r in scalers.select("fold").distinct().collect()} == {1, 2, 3, 4, 5}
    z = (
        spark.read.parquet(made.scaled).where("split = 'train'").select("fold", F.explode("past").alias("h"))
        .groupBy("fold").agg(F.avg("h.FR_price").alias("m"), F.stddev_pop("h.FR_price").alias("s"))
    )
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in z.collect())

    requests = spark.createDataFrame([(datetime(2024, 2, 1, 23),)], "target_date TIMESTAMP")
    model = m.LinearForecast(np.zeros((168, 24)), np.arange(24.0))
    with pytest.raises(ValueError):
        d.predict(spark, requests, rows, model, made)
    found = {k: d.predict(spark, requests, rows, model, made, fold=k).first() for k in (1, 5)}
    for r in spark.read.parquet(made.target_scaler).where("fold IN (1, 5)").collect():
        assert found[r.fold].predicted == pytest.approx(list(np.arange(24.0) * r.scale + r.mean), abs=0.006)
    with pytest.raises(ValueError):
        d.build_dataset(rows, str(tmp_path / "mixed"), "folds", "across")


@pytest.mark.parametrize("shuffle", ["across", "within"])
def test_shuffled_sets_keep_sizes(spark, market, tmp_path, shuffle):
    rows = d.build_features(market).select("ts", "FR_price", "FR_Load_forecast", "Day_sin")
    sizes = []
    for name, mode in (("plain", None), (shuffle, shuffle)):
        made = d.build_dataset(rows, str(tmp_path / name), "fraction", mode)
        sizes.append({r.split: r[1] for r in spark.read.parquet(made.windows).groupBy("split").count().collect()})
    assert sizes[0] == sizes[1] and set(sizes[0]) == {"train", "val", "test"}
    with pytest.raises(ValueError):
        d.build_dataset(rows, str(tmp_path / "bad"), "fraction", "sideways")


def test_tabular_set(market):
    rows = d.build_features(market).select("ts", "FR_price", "DE_price", "Day_sin")
    table = d.build_tabular(rows)
    assert len([c for c in table.columns if "_lag_" in c]) == 73
    train = table.where("split = 'train'").agg(F.avg("price_lag_24h"), F.stddev_pop("price_lag_24h")).first()
    assert train[0] == pytest.approx(0, abs=1e-9) and train[1] == pytest.approx(1)
    assert {r.split for r in table.select("split").distinct().collect()} == {"train", "val", "test"}
