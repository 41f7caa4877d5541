"""End-to-end plans: features, training sets and batch predictions.

Each is a composition of operators. Where a result is read more than once it is written to
Parquet and read back, so later stages neither recompute it nor depend on an executor that
may be lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.constants import CYCLICAL_COLUMNS, FUEL_COLUMNS, LAG_HOURS, MARKET_ZONE
from tsforge.functions.columns import constant_columns, cyclical, filter_years, round2, signed_exp
from tsforge.operators import clean, features, joins, models, scaling, splits, windows
from tsforge.operators.evaluate import paired_stats
from tsforge.session import materialise
from tsforge.sources import io

TARGET = "FR_price"


def build_features(
    market: DataFrame,
    monthly_fuel: DataFrame | None = None,
    target: str = TARGET,
    years: Sequence[int] | None = None,
    fill_fuel: bool = True,
    ts: str = "ts",
    tz: str = MARKET_ZONE,
) -> DataFrame:
    """Wide hourly market rows -> cleaned feature rows: missing values, outlier months,
    monthly fuel prices (or the defaults) and calendar columns."""
    rows = filter_years(market, ts, years, tz) if years else market
    rows = clean.clean_full(rows, ts)
    rows = clean.drop_high_months(rows, ts, target, tz=tz)
    if monthly_fuel is None:
        rows = constant_columns(rows)
    else:
        rows = joins.month_lookup(rows, monthly_fuel, ts, tz=tz)
        if fill_fuel:
            named = rows.withColumn("_all", F.lit(1))
            rows = clean.ffill(named, ["_all"], ts, FUEL_COLUMNS).drop("_all")
    return cyclical(rows, ts, tz)


@dataclass(frozen=True)
class Dataset:
    """Where a training set was written."""

    windows: str
    scaled: str
    past_scaler: str
    future_scaler: str
    target_scaler: str | None
    manifest: str


SCHEMES = ("calendar", "fraction", "folds", "full")


def build_dataset(
    rows: DataFrame,
    out: str,
    scheme: str = "calendar",
    shuffle: str | None = None,
    scale_target: bool = False,
    exclude_known: bool = False,
    target: str = TARGET,
    series: str = "series",
    ts: str = "ts",
    seed: int = 0,
    window_options: dict | None = None,
    **split_options,
) -> Dataset:
    """Feature rows -> raw and scaled windows by split, scalers and manifest below ``out``.

    ``shuffle`` is ``across`` (pool the splits and cut again) or ``within``. Scalers are
    fitted on the training windows, per fold where there are folds.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {SCHEMES}")
    spark = rows.sparkSession
    if series not in rows.columns:
        rows = rows.withColumn(series, F.lit("ALL"))
    keys = [series, ts]
    past, future, _ = features.feature_roles(rows, target, keys, exclude_known)
    io.write_manifest(io.manifest(rows, target, past, future), f"{out}/manifest")

    found = windows.make_windows(rows, [series], ts, past, future, target, **(window_options or {}))
    found.write.parquet(f"{out}/all")
    whole = spark.read.parquet(f"{out}/all")
    # Splits look at the index only; the arrays are joined back once it is decided.
    index = whole.select(series, "anchor", "window_date")
    if scheme == "calendar":
        placed = splits.split_calendar(index, [series], **split_options)
    elif scheme == "fraction":
        placed = splits.split_fraction_gap(index, [series], **split_options)
    elif scheme == "folds":
        placed = splits.folds_expanding(index, [series], **split_options)
    else:
        placed = splits.full_set(index)
    if shuffle is not None and scheme == "folds":
        raise ValueError("shuffling would mix the windows of different folds")
    if shuffle == "across":
        placed = splits.shuffle_across(placed, [series, "anchor"], seed)
    elif shuffle == "within":
        placed = splits.shuffle_within(placed, [series, "anchor"], seed)
    elif shuffle is not None:
        raise ValueError("shuffle must be 'across' or 'within'")
    io.write_windows(whole.join(placed.drop("window_date"), [series, "anchor"]), f"{out}/windows")
    raw = spark.read.parquet(f"{out}/windows")

    by = ["fold"] if scheme == "folds" else []
    train = raw.where("split = 'train'")
    arrays = {"past": past, "future": future, **({"y": None} if scale_target else {})}
    params = materialise(scaling.standard_fit_parts(train, arrays, by), "scalers")
    fitted = {
        "target" if part == "y" else part: params.where(F.col("part") == part).drop("part") for part in arrays
    }
    for name, params in fitted.items():
        scaling.save_scaler(params, f"{out}/scaler_{name}")
    scaled = raw
    # The test windows belong to no fold: they are scaled when a fold's model is applied.
    if by:
        scaled = scaled.where("fold > 0")
    for name, columns in (("past", past), ("future", future)):
        params = scaling.load_scaler(spark, f"{out}/scaler_{name}")
        scaled = scaling.standard_apply_windows(scaled, name, params, columns, by)
    if scale_target:
        scaled = scaling.target_scale(scaled, scaling.load_scaler(spark, f"{out}/scaler_target"), keys=by)
    io.write_windows(scaled, f"{out}/scaled")
    return Dataset(
        f"{out}/windows",
        f"{out}/scaled",
        f"{out}/scaler_past",
        f"{out}/scaler_future",
        f"{out}/scaler_target" if scale_target else None,
        f"{out}/manifest",
    )


def build_tabular(
    rows: DataFrame, target: str = TARGET, series: str = "series", ts: str = "ts", hours: Sequence[int] = LAG_HOURS
) -> DataFrame:
    """One row per hour with the lags of the target, split by row, imputed with the train
    mean and scaled except for the calendar."""
    if series not in rows.columns:
        rows = rows.withColumn(series, F.lit("ALL"))
    lagged = features.drop_incomplete_lags(features.time_lags(rows, [series], ts, target, hours, "price"))
    split = splits.split_fraction_rows(lagged, [series], ts)
    inputs = [c for c in split.columns if c not in (series, ts, target, "split")]
    train = split.where("split = 'train'")
    return scaling.scale_passthrough(split, inputs, train, CYCLICAL_COLUMNS)


def predict(
    spark: SparkSession,
    requests: DataFrame,
    rows: DataFrame,
    model: Callable[[np.ndarray], np.ndarray],
    dataset: Dataset,
    inputs: Column | None = None,
    series: str = "series",
    ts: str = "ts",
    log_space: bool = False,
    fold: int | None = None,
) -> DataFrame:
    """A table of target dates -> 24 predicted and 24 actual prices each, with a status.

    Predictions of a set with a scaled target are scaled back, then taken out of log space. A
    set of folds needs the ``fold`` whose model this is.

    ``inputs`` is the model's input from the scaled ``past`` and ``future`` arrays; by
    default the scaled history of the target.
    """
    roles = io.read_manifest(spark, dataset.manifest)
    if series not in rows.columns:
        rows = rows.withColumn(series, F.lit("ALL"))
    aligned = features.align_columns(rows, list(dict.fromkeys([*roles["past_cols"], *roles["future_cols"]])), [series, ts])
    asked = windows.request_windows(
        requests, aligned, [series], ts, roles["past_cols"], roles["future_cols"], roles["target_col"]
    )

    def scaler(path: str) -> DataFrame:
        params = scaling.load_scaler(spark, path)
        if ("fold" in params.columns) != (fold is not None):
            raise ValueError("a fold is needed for a set of folds, and for no other")
        return params if fold is None else params.where(F.col("fold") == fold)

    ready = asked.where("status = 'ok'")
    for name, columns in (("past", roles["past_cols"]), ("future", roles["future_cols"])):
        ready = scaling.standard_apply_windows(ready, name, scaler(getattr(dataset, f"{name}_scaler")), columns)
    given = models.last_values(roles["target_col"], 168) if inputs is None else inputs
    scored = models.score_windows(ready, model, given)
    if dataset.target_scaler is not None:
        scored = scaling.target_unscale(scored, scaler(dataset.target_scaler), "predicted")
    if log_space:
        scored = scored.withColumn("predicted", F.transform("predicted", signed_exp))
    scored = scored.withColumn("predicted", F.transform("predicted", round2))
    done = scored.select("target_date", series, "predicted", "actual", "status")
    missed = asked.where("status <> 'ok'").select(
        "target_date",
        series,
        F.lit(None).cast("array<double>").alias("predicted"),
        "actual",
        "status",
    )
    return done.unionByName(missed)


def prediction_stats(predictions: DataFrame, series: str = "series") -> DataFrame:
    """Average, RMSE and MAE per answered request."""
    answered = predictions.where("status = 'ok'")
    hours = windows.stack_hours(answered, ["target_date", series], ["predicted", "actual"])
    return paired_stats(hours, ["target_date", series])


