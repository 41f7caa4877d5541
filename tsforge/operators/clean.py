"""Order-aware cleaning: duplicates, fills, drops and outlier months."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.constants import HOUR, MARKET_ZONE, MONTH_PRICE_LIMIT, PRICE_LIMIT, WEEK
from tsforge.functions import ordered
from tsforge.functions.columns import drop_any_null, fixed_width, matching, month_key, threshold_filter
from tsforge.operators.joins import anti_months


def mean_duplicates(df: DataFrame, series: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Duplicate timestamps -> mean of each numeric column."""
    return df.groupBy(*series, ts).agg(*[F.avg(c).alias(c) for c in cols])


def fill_prior_week(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    cols: Sequence[str],
    offset: int = WEEK,
    flag: str | None = None,
) -> DataFrame:
    """Null -> the original value exactly ``offset`` seconds earlier; filled values are not
    used again. ``flag`` adds the number of values filled in the row.

    Looks back over a bounded range, so rows are shuffled once, about a quarter of them
    twice, and no series is held by one task.
    """
    near = ordered.with_context(df, ts, before=offset, after=0)
    back = ordered.range_window(series, ts).rangeBetween(-offset, -offset)
    prior = near.withColumns({f"_prior_{c}": F.max(c).over(back) for c in cols}).where(ordered.OWN)
    counted = prior.withColumn(flag or "_hits", _hits(cols, "_prior_"))
    return _filled(counted, cols, "_prior_").select(*df.columns, *([flag] if flag else []))


def neighbour_interpolate(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    cols: Sequence[str],
    step: int = HOUR,
    flag: str | None = None,
) -> DataFrame:
    """Null -> mean of both neighbours, only when each is exactly ``step`` seconds away."""
    near = ordered.with_context(df, ts, before=step, after=step)
    looked = _interpolated(near, series, ts, cols, step, flag or "_hits").where(ordered.OWN)
    return looked.select(*df.columns, *([flag] if flag else []))


def _hits(cols: Sequence[str], prefix: str) -> Column:
    """How many of ``cols`` are null and have a replacement."""
    found = [(F.col(c).isNull() & F.col(f"{prefix}{c}").isNotNull()).cast("int") for c in cols]
    return reduce(lambda a, b: a + b, found, F.lit(0))


def _filled(rows: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    named = {c: F.coalesce(F.col(c), F.col(f"{prefix}{c}")) for c in cols}
    return (rows.withColumns(named) if named else rows).drop(*[f"{prefix}{c}" for c in cols])


def _interpolated(near: DataFrame, series, ts, cols, step, flag) -> DataFrame:
    over = ordered.range_window(series, ts)
    before, after = over.rangeBetween(-step, -step), over.rangeBetween(step, step)
    means = {f"_mean_{c}": (F.max(c).over(before) + F.max(c).over(after)) / 2 for c in cols}
    rows = near.withColumns(means) if means else near
    return _filled(rows.withColumn(flag, _hits(cols, "_mean_")), cols, "_mean_")


def fill_constant(df: DataFrame, column: str, value: float = 0.0) -> DataFrame:
    return df.fillna({column: value})


def drop_entity_all_null(df: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """Drop a row when, for any entity, all its columns are null."""
    def silent(columns: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])

    return df.where(~reduce(lambda a, b: a | b, [silent(c) for c in families.values()]))


def ffill(
    df: DataFrame, series: Sequence[str], ts: str, cols: Sequence[str], width: int | ordered.EquiDepth = ordered.BUCKET_SECONDS
) -> DataFrame:
    """Last known value in time order."""
    return ordered.fill_gaps(df, series, ts, cols, width=width)


def ffill_bfill(
    df: DataFrame, series: Sequence[str], ts: str, cols: Sequence[str], width: int | ordered.EquiDepth = ordered.BUCKET_SECONDS
) -> DataFrame:
    """Last known value, else the next known one."""
    return ordered.fill_gaps(df, series, ts, cols, backward=True, width=width)


def dedupe_first(df: DataFrame, keys: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """One row per key: the least by ``ties``, then by all other columns. An aggregate, not
    a ranking, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = [*ties, *[c for c in rest if c not in ties]]
    if not rest:
        return df.distinct()
    if len(rest) == 1 and fixed_width(df, rest):
        # The least of one value, null first, needs no struct: the buffer is primitive and hashes.
        (one,) = rest
        least = F.when(F.max(F.col(one).isNull()), F.lit(None)).otherwise(F.min(one))
        return df.groupBy(*keys).agg(least.alias(one)).select(*df.columns)
    least = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_row"))
    return least.select(*[c if c in keys else F.col(f"_row.{c}") for c in df.columns])


def monthly_stats(
    df: DataFrame, ts: str, value: str, series: Sequence[str] = (), tz: str = MARKET_ZONE
) -> DataFrame:
    """Local-month mean and the mean over this and the two month rows before it (null until
    there are three). The window sees one row per series and month."""
    months = df.groupBy(*series, month_key(ts, tz).alias("month")).agg(F.avg(value).alias("mean"))
    each = Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))
    last3 = each.orderBy("month").rowsBetween(-2, 0)
    full = F.count(F.lit(1)).over(last3) == 3
    return months.withColumn("rolling_mean", F.when(full, F.avg("mean").over(last3)))


def drop_high_months(
    df: DataFrame,
    ts: str,
    price: str,
    price_cols: Sequence[str] | None = None,
    limit: float = PRICE_LIMIT,
    month_limit: float = MONTH_PRICE_LIMIT,
    tz: str = MARKET_ZONE,
) -> DataFrame:
    """Drop rows with any price at or above ``limit``, then the months whose rolling mean
    of ``price`` exceeds ``month_limit``."""
    kept = threshold_filter(df, price_cols or matching(df, "price"), limit)
    stats = monthly_stats(kept, ts, price, tz=tz)
    return anti_months(kept, stats.where(F.col("rolling_mean") > F.lit(month_limit)), ts, tz=tz)


def clean_drop_only(
    df: DataFrame, zero_column: str | None = None, load_token: str = "Load_forecast"
) -> DataFrame:
    """Solar, wind, price, load: rows with any null in the family are dropped."""
    rows = drop_any_null(df, "Solar")
    if zero_column and zero_column in rows.columns:
        rows = fill_constant(rows, zero_column)
    for token in ("Wind", "price", load_token):
        rows = drop_any_null(rows, token)
    return rows


STEPS = ("renewables", "prices", "load", "flows")


def _families(df: DataFrame) -> dict[str, list[str]]:
    return {
        "renewables": matching(df, "Solar", "Wind"),
        "prices": matching(df, "price"),
        "load": matching(df, "Load_forecast"),
        "flows": matching(df, "flow"),
    }


def clean_steps(
    df: DataFrame,
    ts: str = "ts",
    series: Sequence[str] = (),
    zero_column: str | None = "FR_Wind_Offshore_forecast",
    fill_flows: bool = False,
) -> DataFrame:
    """The full cleaning sequence as one flagged plan.

    No row is removed here: each step adds ``_missing_<step>`` (nulls it found),
    ``_filled_<step>`` and ``_ok_<step>`` (the row survives it). A step counts and fills
    only rows that survived the earlier ones, and looks back only to such rows, as running
    the steps one after the other would.
    """
    families = _families(df)
    numeric = [c for c in df.columns if c not in (*series, ts)]
    rows = mean_duplicates(df, series, ts, numeric)
    keys = list(series) or ["_all"]
    if not series:
        rows = rows.withColumn("_all", F.lit(1))

    def nulls(columns: Sequence[str]) -> Column:
        if not columns:
            return F.lit(0)
        return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])

    filling = ["prices", "load", *(["flows"] if fill_flows else [])]
    # A row that is looked back to must itself know whether it survived, so each filling
    # step needs one more week of context; one exchange then serves all steps.
    rows = rows.withColumn("_missing_renewables", nulls(families["renewables"]))
    rows = ordered.with_context(rows, ts, before=WEEK * len(filling) + HOUR, after=HOUR)
    rows = _interpolated(rows, keys, ts, families["renewables"], HOUR, "_filled_renewables")
    if zero_column and zero_column in numeric:
        rows = fill_constant(rows, zero_column)
    rows = rows.withColumn("_ok_renewables", nulls(families["renewables"]) == 0)

    week = ordered.range_window(keys, ts).rangeBetween(-WEEK, -WEEK)
    alive = "_ok_renewables"
    for step in ("prices", "load", "flows"):
        columns = families[step]
        rows = rows.withColumn(f"_missing_{step}", nulls(columns))
        if step in filling and columns:
            # Only rows still there may lend a value.
            lent = {f"_prior_{c}": F.max(F.when(F.col(alive), F.col(c))).over(week) for c in columns}
            rows = rows.withColumns(lent).withColumn(f"_filled_{step}", _hits(columns, "_prior_"))
            rows = _filled(rows, columns, "_prior_")
        else:
            rows = rows.withColumn(f"_filled_{step}", F.lit(0))
        rows = rows.withColumn(f"_ok_{step}", F.col(alive) & (nulls(columns) == 0))
        alive = f"_ok_{step}"
    return rows.where(ordered.OWN).drop(ordered.BUCKET, ordered.OWN, "_all")


def clean_full(df: DataFrame, ts: str = "ts", series: Sequence[str] = (), **options) -> DataFrame:
    """Rows left after the full cleaning sequence, in the input's columns."""
    flagged = clean_steps(df, ts, series, **options)
    return flagged.where(F.col(f"_ok_{STEPS[-1]}")).select(*df.columns)
