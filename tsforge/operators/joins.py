"""Joins of readings, flows and monthly prices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.constants import CANONICAL_ENTITIES, ENTITY_CODES, FORECAST_RENAMES, MARKET_ZONE
from tsforge.functions.columns import canonical_names, map_codes, month_key, rename_substring


def merge_outer(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer equi-joins on shared keys; keys coalesce."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), frames)


def merge_outer_ts(wide: DataFrame, flows: DataFrame, ts: str = "ts") -> DataFrame:
    return wide.join(flows, ts, "full")


def multi_left_join(base: DataFrame, others: Sequence[DataFrame], on: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "left"), others, base)


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """One row per key; a second row for a key stops the job. Lazy."""
    rest = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(
        F.first(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_copies")
    )
    message = F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))
    checked = F.when(F.col("_copies") == 1, F.col("_row")).otherwise(F.raise_error(message))
    return grouped.select(key, checked.alias("_row")).select(key, "_row.*")


def month_lookup(
    df: DataFrame, monthly: DataFrame, ts: str, month: str = "Month", tz: str = MARKET_ZONE
) -> DataFrame:
    """Hourly rows with the prices of their local month.

    A month table has one row per calendar month after ``unique_by``, which keeps it below
    any broadcast limit; Spark still checks its size before it broadcasts.
    """
    prices = unique_by(monthly, month)
    return df.withColumn(month, month_key(ts, tz)).join(prices, month, "left").drop(month)


def anti_months(
    df: DataFrame, months: DataFrame, ts: str, month: str = "month", tz: str = MARKET_ZONE
) -> DataFrame:
    """Rows whose local month is not listed."""
    listed = months.select(F.col(month).alias("_month")).distinct()
    return df.withColumn("_month", month_key(ts, tz)).join(listed, "_month", "left_anti").drop("_month")


def assemble_market(
    prices: DataFrame,
    load: DataFrame,
    wind_solar: DataFrame,
    flows: DataFrame,
    codes: Sequence[str],
    forecast_types: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    entity_codes: Mapping[str, str] = ENTITY_CODES,
    ignore_unlisted: bool = False,
) -> DataFrame:
    """One wide row per hour from the four typed tables.

    The result is that of merging price, load and forecasts on (hour, entity), pivoting by
    entity code and merging the pivoted flows on the hour, all full outer. As every merge
    only lines cells up by hour, the tables become ``(hour, column, value)`` cells instead:
    each table is averaged to the hour in its own partial-combining aggregate, and one
    aggregate by hour lays all cells out, so no reading is shuffled for a join.

    Entities without a code stop the job; flows with such an end are dropped. A cell outside
    ``codes``, ``forecast_types`` and ``pairs`` stops the job, or is left out where
    ``ignore_unlisted`` says so. Where two names of one entity report the same flow, the later name in sort order wins.
    """

    def column(suffix):
        return F.concat_ws("_", "code", F.lit(suffix) if isinstance(suffix, str) else suffix)

    def cells(df, suffix, value):
        coded = map_codes(df, "country", entity_codes, "code", strict=True)
        return coded.groupBy(F.date_trunc("hour", "timestamp").alias("ts"), column(suffix).alias("column")).agg(
            F.avg(value).alias("value")
        )

    canonical = canonical_names(prices, CANONICAL_ENTITIES, ["country"])
    directed = map_codes(map_codes(flows, "country_from", entity_codes, "_from"), "country_to", entity_codes, "_to")
    hourly = (
        directed.where(F.col("_from").isNotNull() & F.col("_to").isNotNull())
        .groupBy(
            F.date_trunc("hour", "timestamp").alias("ts"),
            F.concat_ws("_", "_from", "_to", F.lit("flow")).alias("column"),
            "country_from",
            "country_to",
        )
        .agg(F.avg("flow").alias("flow"))
    )
    latest = hourly.groupBy("ts", "column").agg(
        F.max_by("flow", F.struct("country_from", "country_to")).alias("value")
    )
    long = (
        cells(canonical, "price", "price")
        .unionByName(cells(load, "forecast_load", "forecast_load"))
        .unionByName(cells(wind_solar, F.col("forecast_type"), "value"))
        .unionByName(latest)
    )
    measures = ["price", "forecast_load", *forecast_types]
    names = [f"{c}_{m}" for m in measures for c in codes] + [f"{a}_{b}_flow" for a, b in pairs]
    listed = F.col("column").isin(names)
    if ignore_unlisted:
        long = long.where(listed)
    else:
        stop = F.raise_error(F.concat(F.lit("a column that is not listed: "), F.col("column")))
        long = long.withColumn("column", F.when(listed, F.col("column")).otherwise(stop))
    wide = long.groupBy("ts").agg(*[F.max(F.when(F.col("column") == n, F.col("value"))).alias(n) for n in names])
    return rename_substring(wide, FORECAST_RENAMES)
