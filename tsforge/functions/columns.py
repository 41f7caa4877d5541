"""Projections, filters, renames and scalar functions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.constants import (
    AGG_CONSUMPTION,
    AGG_OUTPUT,
    DAY,
    DEFAULT_FUEL,
    GENERATION_TYPES,
    MARKET_ZONE,
    PRICE_LIMIT,
    PUMPED_STORAGE,
    WEEK,
)

# ---------------------------------------------------------------- time zones


def localise(df: DataFrame, ts: str = "ts", tz: str = MARKET_ZONE, out: str = "local_ts") -> DataFrame:
    """Keep the instant, add the wall clock of the market zone."""
    return df.withColumn(out, F.from_utc_timestamp(ts, tz))


def attach_zone(df: DataFrame, ts: str, tz: str = MARKET_ZONE) -> DataFrame:
    """Wall-clock stamps of ``tz`` -> instants."""
    return df.withColumn(ts, F.to_utc_timestamp(ts, tz))


def local_midnight(ts: Column | str, tz: str = MARKET_ZONE) -> Column:
    """Instant at which the local day of ``ts`` starts."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, tz)), tz)


def add_seconds(ts: Column | str, seconds: int) -> Column:
    """``ts`` moved by absolute time."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return column + F.make_dt_interval(secs=F.lit(float(seconds)))


def add_hours(ts: Column | str, hours: int) -> Column:
    return add_seconds(ts, hours * 3600)


# ------------------------------------------------------------------- renames


def canonical_names(df: DataFrame, names: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    return df.replace(dict(names), subset=list(columns))


def map_codes(
    df: DataFrame, column: str, codes: Mapping[str, str], out: str, strict: bool = False
) -> DataFrame:
    """Dictionary lookup. Unknown names give null, or stop the job when ``strict``."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    code = F.create_map(*pairs)[F.col(column)]
    if strict:
        unknown = F.raise_error(F.concat(F.lit(f"no code for {column} = "), F.col(column)))
        code = F.when(code.isNull() & F.col(column).isNotNull(), unknown.cast("string")).otherwise(code)
    return df.withColumn(out, code)


def rename_units(df: DataFrame, renames: Mapping[str, str], unused: Sequence[str] = ()) -> DataFrame:
    return df.drop(*unused).withColumnsRenamed(dict(renames))


def rename_substring(df: DataFrame, replacements: Sequence[tuple[str, str]]) -> DataFrame:
    """Ordered literal replacement inside column names."""
    names = df.columns
    for old, new in replacements:
        names = [name.replace(old, new) for name in names]
    return df.toDF(*names)


def clean_type_label(column: Column | str) -> Column:
    """Text before ``' ['``, trimmed."""
    return F.trim(F.substring_index(column, " [", 1))


def route_types(
    df: DataFrame,
    type_col: str = "type",
    agg_col: str = "aggregation",
    allowed: Sequence[str] = tuple(GENERATION_TYPES),
    out: str = "generation_type",
) -> DataFrame:
    """Split pumped storage by aggregation kind, keep only output of other types, and only
    types of the list. A row without an aggregation kind keeps its cleaned label."""
    kind, label = F.col(agg_col), F.col(type_col)
    pumped = F.when(kind == AGG_OUTPUT, f"{PUMPED_STORAGE}_Generation").when(
        kind == AGG_CONSUMPTION, f"{PUMPED_STORAGE}_Consumption"
    )
    routed = (
        F.when(kind.isNull(), clean_type_label(label))
        .when(label == PUMPED_STORAGE, pumped)
        .when(kind == AGG_OUTPUT, label)
    )
    return df.withColumn(out, routed).where(F.col(out).isin(list(allowed)))


# ------------------------------------------------------------------- filters


def matching(df: DataFrame, *tokens: str) -> list[str]:
    """Columns whose name contains any token, in schema order."""
    return [c for c in df.columns if any(token in c for token in tokens)]


def select_family(df: DataFrame, token: str, extras: Sequence[str] = ()) -> DataFrame:
    family = [c for c in matching(df, token) if c not in extras]
    return df.select(*extras, *family)


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def drop_any_null(df: DataFrame, *tokens: str) -> DataFrame:
    columns = matching(df, *tokens)
    return df.dropna(how="any", subset=columns) if columns else df


def _utc(wall: datetime, tz: str) -> Column:
    instant = wall.replace(tzinfo=ZoneInfo(tz)).astimezone(ZoneInfo("UTC"))
    return F.lit(instant.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def filter_years(df: DataFrame, ts: str, years: Sequence[int], tz: str = MARKET_ZONE) -> DataFrame:
    """Rows whose local year is listed. The years are turned into UTC bounds on the raw
    column, one range per run of years, so that Parquet row groups can be skipped."""
    wanted = sorted(set(years))
    runs: list[list[int]] = []
    for year in wanted:
        if runs and runs[-1][1] == year:
            runs[-1][1] = year + 1
        else:
            runs.append([year, year + 1])
    keep = F.lit(False)
    for i, (first, stop) in enumerate(runs):
        inside = (F.col(ts) >= _utc(datetime(first, 1, 1), tz)) & (F.col(ts) < _utc(datetime(stop, 1, 1), tz))
        keep = inside if i == 0 else keep | inside
    return df.where(keep)


def filter_range(
    df: DataFrame, ts: str, start: str, end: str, tz: str = MARKET_ZONE, require_rows: bool = False
) -> DataFrame:
    """Inclusive local date range ``YYYY-MM-DD``; ``require_rows`` makes no rows an error
    (this runs a job that stops at the first row)."""
    first = datetime.fromisoformat(start)
    last = datetime.fromisoformat(end).replace(hour=23, minute=59, second=59, microsecond=999999)
    found = df.where(F.col(ts).between(_utc(first, tz), _utc(last, tz)))
    if require_rows and found.isEmpty():
        raise ValueError(f"no rows between {start} and {end}")
    return found


def threshold_filter(df: DataFrame, columns: Sequence[str], limit: float = PRICE_LIMIT) -> DataFrame:
    """Rows where every column is below the limit; null or NaN fails."""
    if not columns:
        raise ValueError("threshold_filter needs at least one column")
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.col(c) < F.lit(limit))
    return df.where(keep)


# ---------------------------------------------------------------- expressions


def month_key(ts: Column | str, tz: str = MARKET_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM")


def fx_convert(df: DataFrame, amount: str, rate: str, out: str) -> DataFrame:
    """``out = amount * rate``; the inputs are dropped."""
    return df.withColumn("_converted", F.col(amount) * F.col(rate)).drop(amount, rate).withColumnRenamed(
        "_converted", out
    )


def constant_columns(df: DataFrame, defaults: Mapping[str, float] = DEFAULT_FUEL) -> DataFrame:
    """Three fuel columns filled from defaults, coal converted to EUR."""
    return df.withColumns(
        {
            "TTF_EUR": F.lit(float(defaults["TTF_EUR"])),
            "EUA_EUR": F.lit(float(defaults["EUA_EUR"])),
            "ARA_EUR": F.lit(float(defaults["ARA_USD"]) * float(defaults["USD_EUR"])),
        }
    )


def _turns(ts: Column | str, period: Column | int) -> Column:
    seconds = F.unix_micros(ts) / F.lit(1_000_000)
    return F.lit(2 * math.pi) * seconds / (period if isinstance(period, Column) else F.lit(period))


def cyclical_day_week(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(
        {
            "Day_sin": F.sin(_turns(ts, DAY)),
            "Day_cos": F.cos(_turns(ts, DAY)),
            "Week_sin": F.sin(_turns(ts, WEEK)),
            "Week_cos": F.cos(_turns(ts, WEEK)),
        }
    )


def cyclical_year(df: DataFrame, ts: str = "ts", tz: str = MARKET_ZONE) -> DataFrame:
    """The year is 366 days long when the local year is a leap year."""
    year = F.year(F.from_utc_timestamp(ts, tz))
    days = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    angle = _turns(ts, days * F.lit(DAY))
    return df.withColumns({"Year_sin": F.sin(angle), "Year_cos": F.cos(angle)})


def cyclical(df: DataFrame, ts: str = "ts", tz: str = MARKET_ZONE) -> DataFrame:
    return cyclical_year(cyclical_day_week(df, ts), ts, tz)


def signed_log(x: Column | str) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_exp(x: Column | str) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def round2(x: Column | str) -> Column:
    return F.bround(x, 2)


def parse_dmy(text: Column | str, tz: str = MARKET_ZONE) -> Column:
    """``DD/MM/YYYY`` -> instant of that local midnight; null when the text is no date."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("dd/MM/yyyy")), tz)


def fixed_width(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether aggregates of these columns keep buffers that can be updated in place."""
    wide = ("string", "binary", "array", "map", "struct", "variant", "interval")
    return not any(df.schema[c].dataType.typeName().startswith(wide) for c in columns)
