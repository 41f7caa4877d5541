"""Error statistics over ``(keys, hour, y, predicted)`` rows. Each is one partial-combining
aggregate, so the metrics of any grouping cost one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.functions.columns import signed_exp

SAFE = 1e-6


def _error(y: str, predicted: str) -> Column:
    return F.col(y) - F.col(predicted)


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def mae(error: Column) -> Column:
    return F.avg(F.abs(error))


def rmse_mae(df: DataFrame, y: str = "y", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    e = _error(y, predicted)
    return df.groupBy(*by).agg(rmse(e).alias("rmse"), mae(e).alias("mae"))


def mape_safe(df: DataFrame, y: str = "y", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Percentage error with the denominator kept off zero."""
    share = F.abs(_error(y, predicted) / F.greatest(F.abs(y), F.lit(SAFE)))
    return df.groupBy(*by).agg((F.avg(share) * 100).alias("mape"))


def mape_raw(df: DataFrame, y: str = "y", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Percentage error without protection: rows with ``y = 0`` are left out and counted."""
    share = F.abs(_error(y, predicted) / F.nullif(F.col(y), F.lit(0.0)))
    return df.groupBy(*by).agg(
        (F.avg(share) * 100).alias("mape"), F.count_if(F.col(y) == 0).alias("excluded")
    )


def hourly_profile(
    df: DataFrame, y: str = "y", predicted: str = "predicted", hour: str = "hour", by: Sequence[str] = ()
) -> DataFrame:
    """Mean true and predicted value per horizon hour."""
    return df.groupBy(*by, hour).agg(F.avg(y).alias(y), F.avg(predicted).alias(predicted))


def profile_error(df: DataFrame, y: str = "y", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """RMSE and MAE of the mean daily profile."""
    return rmse_mae(hourly_profile(df, y, predicted, by=by), y, predicted, by)


def paired_stats(
    df: DataFrame, keys: Sequence[str], y: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Per request: average prediction, average known actual, RMSE and MAE over known
    pairs. A request without any known actual gives no row."""
    e = F.col(predicted) - F.col(y)
    return (
        df.groupBy(*keys)
        .agg(
            F.avg(predicted).alias("avg_predicted"),
            F.avg(y).alias("avg_actual"),
            rmse(e).alias("rmse"),
            mae(e).alias("mae"),
            F.count(e).alias("_pairs"),
        )
        .where(F.col("_pairs") > 0)
        .drop("_pairs")
    )


def max_signed_error(
    df: DataFrame, y: str = "y", predicted: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by).agg(F.max(F.col(predicted) - F.col(y)).alias("max_error"))


def fold_scores(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """MSE, RMSE and MAE per fold and split."""
    e = _error(y, predicted)
    return df.groupBy("fold", "split").agg(
        F.avg(e * e).alias("mse"), rmse(e).alias("rmse"), mae(e).alias("mae")
    )


def fold_mean(scores: DataFrame, metrics: Sequence[str] = ("mse", "rmse", "mae")) -> DataFrame:
    """Mean of each metric over the folds, per split."""
    return scores.groupBy("split").agg(*[F.avg(m).alias(m) for m in metrics])


def dual_space_eval(
    df: DataFrame, y_log: str = "y", predicted_log: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """RMSE in log space, RMSE and MAE in price space, from log-space values, in one pass."""
    log_error = _error(y_log, predicted_log)
    error = signed_exp(y_log) - signed_exp(predicted_log)
    return df.groupBy(*by).agg(
        rmse(log_error).alias("log_rmse"), rmse(error).alias("rmse"), mae(error).alias("mae")
    )
