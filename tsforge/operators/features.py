"""Lag features and column roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.constants import CYCLICAL_COLUMNS, HOUR, LAG_HOURS
from tsforge.functions import ordered
from tsforge.functions.columns import matching


def time_lags(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    column: str,
    hours: Sequence[int] = LAG_HOURS,
    prefix: str | None = None,
    step: int | None = HOUR,
) -> DataFrame:
    """Add ``<column>_lag_<h>h``: the value exactly ``h`` hours earlier, by time.

    All lags share one exchange, in which a row is copied only into the next time bucket
    when that bucket looks back to it (15 % of rows for 96 hours).

    Stamps are expected on a grid of ``step`` seconds, once each; anything else stops the
    job. Missing steps are then filled with empty rows inside the bucket, so that rows and
    time run in parallel and a lag is an offset, which costs a fraction of a range frame.
    ``step=None`` takes any stamps, with one range frame per lag.
    """
    name = prefix or column
    near = ordered.with_context(df, ts, before=max(hours) * HOUR, after=0)
    if step is None:
        over = ordered.range_window(series, ts)
        lags = {
            f"{name}_lag_{h}h": F.max(column).over(over.rangeBetween(-h * HOUR, -h * HOUR)) for h in hours
        }
        return near.withColumns(lags).where(ordered.OWN).select(*df.columns, *lags)
    if any(h * HOUR % step for h in hours):
        raise ValueError("lags must be whole steps")
    second = F.unix_seconds(ts)
    seen = near.withColumn("_before", F.lag(second).over(ordered.row_window(series, ts)))
    fits = (F.pmod(F.unix_micros(ts), F.lit(step * 1_000_000)) == 0) & (
        F.col("_before").isNull() | (F.col("_before") < second)
    )
    start = F.coalesce(F.col("_before"), second - step) + step
    steps = F.when(fits, F.sequence(start, second, F.lit(step).cast("long"))).otherwise(
        F.raise_error(F.concat(F.lit(f"{ts} is off the {step} s grid or repeated: "), F.col(ts).cast("string")))
    )
    dense = seen.withColumn("_second", F.explode(steps))
    real = F.col("_second") == second
    value = F.when(real, F.col(column))
    over = Window.partitionBy(*series, ordered.BUCKET).orderBy("_second")
    lags = {f"{name}_lag_{h}h": F.lag(value, h * HOUR // step).over(over) for h in hours}
    return dense.withColumns(lags).where(F.col(ordered.OWN) & real).select(*df.columns, *lags)


def drop_incomplete_lags(df: DataFrame, token: str = "_lag_", require_rows: bool = False) -> DataFrame:
    """Rows with every lag; ``require_rows`` makes none left an error (runs a job)."""
    kept = df.dropna(subset=matching(df, token))
    if require_rows and kept.isEmpty():
        raise ValueError("no row has all its lags")
    return kept


def feature_roles(
    df: DataFrame, target: str, keys: Sequence[str] = ("ts",), exclude_known: bool = False
) -> tuple[list[str], list[str], str]:
    """``(past, future, target)`` column lists, from names alone.

    Future-known columns are the forecasts and the calendar; past columns are all features
    or, with ``exclude_known``, those not known in the future.
    """
    features = [c for c in df.columns if c not in keys]
    if target not in features:
        raise ValueError(f"target {target!r} is not a column")
    future = [c for c in features if "forecast" in c]
    future += [c for c in CYCLICAL_COLUMNS if c in features and c not in future]
    past = [c for c in features if c not in future] if exclude_known else features
    return past, future, target


def align_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Reorder to a saved manifest; a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*keys, *columns)
