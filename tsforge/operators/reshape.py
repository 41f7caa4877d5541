"""Resampling, pivots and unpivots. Every aggregate combines before it shuffles, and every
pivot is given its values: the schema never depends on the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.functions.columns import route_types


def resample(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    unit: str = "hour",
    aggs: Mapping[str, Column] | Sequence[str] = ("value",),
) -> DataFrame:
    """One row per series and ``unit``; ``aggs`` are names to average or named columns."""
    named = aggs if isinstance(aggs, Mapping) else {c: F.avg(c) for c in aggs}
    return df.groupBy(*series, F.date_trunc(unit, ts).alias(ts)).agg(
        *[column.alias(name) for name, column in named.items()]
    )


def hour_grid(df: DataFrame, series: Sequence[str], ts: str) -> DataFrame:
    """Every hour between the first and last of each series (bounded by the calendar)."""
    span = df.groupBy(*series).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    hours = F.sequence(F.date_trunc("hour", "_lo"), F.date_trunc("hour", "_hi"), F.expr("INTERVAL 1 HOUR"))
    return span.select(*series, F.explode(hours).alias(ts))


def resample_grid(
    df: DataFrame, series: Sequence[str], ts: str, aggs: Mapping[str, Column] | Sequence[str] = ("value",)
) -> DataFrame:
    """Hourly mean on a gapless grid; empty hours are null. The grid needs only the span of
    each series, a narrow second scan that shuffles one row per series and task. Readings
    without a series or a time have no place on a grid and are left out."""
    keyed = df.dropna(subset=[*series, ts])
    hourly = resample(keyed, series, ts, "hour", aggs)
    return hour_grid(keyed, series, ts).join(hourly, [*series, ts], "left")


def unpivot_types(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "type", value: str = "value"
) -> DataFrame:
    """Wide types -> long rows, nulls dropped."""
    return df.unpivot(list(ids), list(values), name, value).where(F.col(value).isNotNull())


def unpivot_generation(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], separator: str = "|"
) -> DataFrame:
    """Wide ``type|aggregation`` columns -> long, routed and allow-listed generation rows."""
    long = unpivot_types(df, ids, values, "_label", "value")
    at = F.instr("_label", separator)
    kind = F.when(at > 0, F.substring_index("_label", separator, -1))
    label = F.when(at > 0, F.substring_index("_label", separator, 1)).otherwise(F.col("_label"))
    split = long.withColumns({"type": label, "aggregation": kind})
    return route_types(split).select(*ids, "generation_type", "value")


def pivot_type_mean(
    df: DataFrame, keys: Sequence[str], type_col: str, types: Sequence[str], value: str = "value"
) -> DataFrame:
    """Long types -> columns, mean of duplicates."""
    return df.groupBy(*keys).pivot(type_col, list(types)).agg(F.avg(value))


def pivot_entity(
    df: DataFrame, keys: Sequence[str], code: str, codes: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Measures x entity -> ``CODE_measure`` columns, mean of duplicates."""
    wide = df.groupBy(*keys).pivot(code, list(codes)).agg(*[F.avg(m).alias(m) for m in measures])
    if len(measures) == 1:  # Spark leaves out the measure name when there is just one
        wide = wide.withColumnsRenamed({c: f"{c}_{measures[0]}" for c in codes})
    return wide


def pivot_pairs(
    df: DataFrame,
    keys: Sequence[str],
    frm: str,
    to: str,
    value: str,
    order: str,
    pairs: Sequence[tuple[str, str]],
    suffix: str = "flow",
) -> DataFrame:
    """Directed pairs -> ``FROM_TO_flow`` columns. Rows with an unknown end are dropped;
    of duplicate rows the one with the greatest ``order`` wins, value deciding ties.

    Rows of one order combine by hash before anything is compared, so raw readings are not sorted.
    """
    names = [f"{a}_{b}_{suffix}" for a, b in pairs]
    known = df.where(F.col(frm).isNotNull() & F.col(to).isNotNull())
    labelled = known.withColumn("_pair", F.concat_ws("_", frm, to, F.lit(suffix)))
    greatest = labelled.groupBy(*keys, "_pair", F.col(order).alias("_order")).agg(F.max(value).alias("_value"))
    newest = F.max_by("_value", "_order")
    unordered = F.max(F.when(F.col("_order").isNull(), F.col("_value")))
    return (
        greatest.groupBy(*keys)
        .pivot("_pair", names)
        .agg(F.when(F.max("_order").isNull(), unordered).otherwise(newest))
    )


def pivot_generation(
    df: DataFrame,
    ts: str,
    entity: str,
    codes: Sequence[str],
    types: Sequence[str],
    dropped: Sequence[str] = (),
    type_col: str = "generation_type",
    value: str = "value",
) -> DataFrame:
    """Generation mix by type, unwanted types dropped, then by entity: ``CODE_type``.
    Averages per (entity, type) and pivots both at once, so there is one shuffle."""
    kept = [t for t in types if t not in dropped]
    names = [f"{c}_{t}" for c in codes for t in kept]
    labelled = df.withColumn("_column", F.concat_ws("_", entity, type_col))
    return labelled.where(F.col(type_col).isin(kept)).groupBy(ts).pivot("_column", names).agg(F.avg(value))
