"""Load control and data quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tsforge.constants import CHUNK_DAYS, MARKET_ZONE, ZONE_VALIDITY
from tsforge.session import literal_table
from tsforge.operators.clean import STEPS, clean_steps

# --------------------------------------------------------------- load control


def chunks_of_years(
    df: DataFrame, start_year: str, end_year: str, days: int = CHUNK_DAYS, tz: str = MARKET_ZONE
) -> DataFrame:
    """Add half-open ``[start_date, end_date)`` chunks that cover each row's local years,
    the last one clipped. A row yields ``365 / days`` chunks a year."""
    first = F.make_timestamp(F.col(start_year), *[F.lit(x) for x in (1, 1, 0, 0, 0)])
    stop = F.make_timestamp(F.col(end_year) + 1, *[F.lit(x) for x in (1, 1, 0, 0, 0)])
    step = F.make_dt_interval(days=F.lit(days))
    starts = F.filter(F.sequence(first, stop, step), lambda t: t < stop)
    cut = df.withColumn("_start", F.explode(starts)).withColumn(
        "_end", F.least(F.col("_start") + step, stop)
    )
    return cut.select(
        *df.columns,
        F.to_utc_timestamp("_start", tz).alias("start_date"),
        F.to_utc_timestamp("_end", tz).alias("end_date"),
    )


def chunk_calendar(
    spark: SparkSession, start_year: int, end_year: int, days: int = CHUNK_DAYS, tz: str = MARKET_ZONE
) -> DataFrame:
    years = spark.range(1).select(F.lit(start_year).alias("a"), F.lit(end_year).alias("b"))
    return chunks_of_years(years, "a", "b", days, tz).select("start_date", "end_date")


def expected_chunks(entity_chunks: DataFrame, data_types: Sequence[str]) -> DataFrame:
    """Each entity chunk once per data type (a literal list, so no join)."""
    kinds = F.array(*[F.lit(t) for t in data_types])
    return entity_chunks.withColumn("data_type", F.explode(kinds))


CHUNK_KEYS = ["country", "data_type", "start_date", "end_date"]


def pending(expected: DataFrame, log: DataFrame, keys: Sequence[str] = CHUNK_KEYS) -> DataFrame:
    """Expected chunks without a ``success`` row in the log."""
    done = log.where(F.col("status") == "success").select(*keys)
    return expected.join(done, list(keys), "left_anti")


def zone_table(spark: SparkSession, zones: Sequence[tuple] = ZONE_VALIDITY) -> DataFrame:
    """Zone validity as ``(country, zone_code, valid_from, valid_to)``; ``valid_to`` is
    exclusive and nulls are open. Dates are local midnights of the market zone."""
    rows = literal_table(
        spark, [tuple(z) for z in zones], "country STRING, zone_code STRING, valid_from STRING, valid_to STRING"
    )
    return rows.withColumns(
        {
            c: F.to_utc_timestamp(F.col(c).cast("timestamp"), MARKET_ZONE)
            for c in ("valid_from", "valid_to")
        }
    )


def zone_at(df: DataFrame, zones: DataFrame, ts: str = "ts", entity: str = "country") -> DataFrame:
    """Add the zone code valid at ``ts``; null where there is none. Joined on the entity,
    with validity as the range part of the condition."""
    z = zones.select(F.col("country").alias("_entity"), "zone_code", "valid_from", "valid_to")
    inside = (
        (F.col(entity) == F.col("_entity"))
        & (F.col("valid_from").isNull() | (F.col(ts) >= F.col("valid_from")))
        & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to")))
    )
    return df.join(z, inside, "left").drop("_entity", "valid_from", "valid_to")


def spanning(
    chunks: DataFrame, zones: DataFrame, entity: str = "country", skip: bool = False
) -> DataFrame:
    """Chunks that contain a change of validity, or (``skip``) the ones that do not."""
    changes = zones.where(F.col("valid_from").isNotNull()).select(
        F.col("country").alias("_entity"), F.col("valid_from").alias("_change")
    )
    across = (
        (F.col(entity) == F.col("_entity"))
        & (F.col("start_date") < F.col("_change"))
        & (F.col("end_date") >= F.col("_change"))
    )
    return chunks.join(changes, across, "left_anti" if skip else "left_semi")


def pair_tasks(chunks: DataFrame, hub: str, neighbours: Sequence[str] | Column) -> DataFrame:
    """Both directions of every hub-neighbour pair for each chunk. ``neighbours`` is a
    literal list or an array column."""
    names = neighbours if isinstance(neighbours, Column) else F.array(*[F.lit(n) for n in neighbours])
    pairs = F.flatten(
        F.transform(
            names,
            lambda n: F.array(
                F.struct(F.lit(hub).alias("country_from"), n.alias("country_to")),
                F.struct(n.alias("country_from"), F.lit(hub).alias("country_to")),
            ),
        )
    )
    return chunks.select("*", F.explode(pairs).alias("_pair")).select(*chunks.columns, "_pair.*")


# ------------------------------------------------------------------- reports


def summary(
    df: DataFrame, keys: Sequence[str], first: str, last: str | None = None, measures: Sequence[str] = ()
) -> DataFrame:
    """First, last and row count per key, and the known values of each measure."""
    return df.groupBy(*keys).agg(
        F.min(first).alias("first_date"),
        F.max(last or first).alias("last_date"),
        F.count(F.lit(1)).alias("total_records"),
        *[F.count(m).alias(f"{m}_records") for m in measures],
    )


def log_summary(log: DataFrame) -> DataFrame:
    """Covered range and number of successful chunks per entity and type."""
    done = summary(log.where(F.col("status") == "success"), ["country", "data_type"], "start_date", "end_date")
    return done.withColumnsRenamed(
        {"first_date": "first_chunk", "last_date": "last_chunk", "total_records": "chunks"}
    )


def entities(tables: Mapping[str, DataFrame], flows: Sequence[str] = ("crossborder_flows",)) -> DataFrame:
    """Sorted distinct entities; flow tables contribute both ends. Each table is reduced to
    its distinct names before the union."""
    parts = []
    for name, df in tables.items():
        ends = ("country_from", "country_to") if name in flows else ("country",)
        parts += [df.select(F.col(c).alias("country")).distinct() for c in ends]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct().orderBy("country")


def pairs_of(df: DataFrame, entity: str, frm: str = "country_from", to: str = "country_to") -> DataFrame:
    """Distinct ordered pairs in which either end is ``entity``."""
    return df.where((F.col(frm) == entity) | (F.col(to) == entity)).select(frm, to).distinct()


def gap_report(
    df: DataFrame, series: Sequence[str], ts: str, start: str, end: str, kind: str = "value"
) -> DataFrame:
    """Series with hours missing from ``[start, end]`` (inclusive, UTC text).

    The grid is regular, so a series misses as many hours as it lacks distinct on-grid
    stamps: counting them needs no grid rows and no join.
    """
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    expected = F.floor((F.unix_seconds(hi) - F.unix_seconds(lo)) / 3600) + 1
    on_grid = F.col(ts).between(lo, hi) & (F.pmod(F.unix_micros(ts) - F.unix_micros(lo), F.lit(3_600_000_000)) == 0)
    stamps = df.groupBy(*series, F.when(on_grid, F.col(ts)).alias("_hour")).agg(F.count(F.lit(1)).alias("_rows"))
    seen = stamps.groupBy(*series).agg(F.count("_hour").alias("_seen"))
    return (
        seen.select(
            F.concat_ws("->", *series).alias("name"),
            F.lit(kind).alias("type"),
            (expected - F.col("_seen")).cast("long").alias("missing"),
            expected.cast("long").alias("expected"),
        )
        .where(F.col("missing") > 0)
    )


def missing_hours(df: DataFrame, series: Sequence[str], ts: str, start: str, end: str) -> DataFrame:
    """The missing stamps themselves: the grid of each series without its rows."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    hours = F.sequence(lo, hi, F.expr("INTERVAL 1 HOUR"))
    grid = df.select(*series).distinct().withColumn(ts, F.explode(hours))
    return grid.join(df.select(*series, ts), [*series, ts], "left_anti")


# ------------------------------------------------------------------- deletes


def without_entity(df: DataFrame, entity: str | None, columns: Sequence[str] = ("country",)) -> DataFrame:
    """Rows in which no listed column equals ``entity`` (nulls stay); none for ``None``."""
    if entity is None:
        return df.where("false")
    hit = reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(entity) for c in columns])
    return df.where(~hit)


def clear_log(
    log: DataFrame, countries: Sequence[str] | None = None, data_types: Sequence[str] | None = None
) -> DataFrame:
    """The log without its successful rows of the given entities and types."""
    hit = F.col("status").eqNullSafe("success")
    if countries:
        hit = hit & F.coalesce(F.col("country").isin(list(countries)), F.lit(False))
    if data_types:
        hit = hit & F.coalesce(F.col("data_type").isin(list(data_types)), F.lit(False))
    return log.where(~hit)


def delete_by_entity(
    df: DataFrame, log: DataFrame, entity: str | None, data_type: str, columns: Sequence[str] = ("country",)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows left, log rows left, and a one-row ``(deleted, log_deleted)`` count."""
    hit = F.lit(True)
    if entity is not None:
        hit = reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(entity) for c in columns])
    log_hit = F.col("data_type").eqNullSafe(data_type)
    if entity is not None:
        log_hit = log_hit & F.col("country").eqNullSafe(entity)
    counted = df.select(F.lit("rows").alias("what"), hit.alias("hit")).unionByName(
        log.select(F.lit("log").alias("what"), log_hit.alias("hit"))
    )
    deleted = counted.agg(
        F.count_if(F.col("hit") & (F.col("what") == "rows")).alias("deleted"),
        F.count_if(F.col("hit") & (F.col("what") == "log")).alias("log_deleted"),
    )
    return df.where(~hit), log.where(~log_hit), deleted


def rewrite_without(
    df: DataFrame,
    path: str,
    entity: str,
    partitions: Sequence[str] = (),
    columns: Sequence[str] = ("country",),
) -> int:
    """Write the table without an entity to the new folder ``path`` and return how many rows
    were left out, observed while writing. A new folder and not an overwrite in place:
    replacing partitions cannot remove one that loses all its rows."""
    hit = reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(entity) for c in columns])
    seen = Observation("rewrite")
    left = df.observe(seen, F.count_if(hit).alias("deleted")).where(~hit)
    left.write.partitionBy(*partitions).parquet(path)
    return seen.get["deleted"]


# ------------------------------------------------------------ cleaning reports


def step_report(df: DataFrame, ts: str = "ts", series: Sequence[str] = (), **options) -> DataFrame:
    """Per cleaning step: nulls found, filled and left, rows dropped and left, share kept.

    One aggregation over the flags of ``clean_steps``; the totals are then unpivoted.
    """
    flags = clean_steps(df, ts, series, **options)
    alive = F.lit(True)
    sums = [F.count(F.lit(1)).alias("_rows")]
    for step in STEPS:
        sums += [
            F.coalesce(F.sum(F.when(alive, F.col(f"_missing_{step}"))), F.lit(0)).cast("long").alias(f"m_{step}"),
            F.coalesce(F.sum(F.when(alive, F.col(f"_filled_{step}"))), F.lit(0)).cast("long").alias(f"f_{step}"),
            F.count_if(F.col(f"_ok_{step}")).alias(f"r_{step}"),
        ]
        alive = F.col(f"_ok_{step}")
    totals = flags.agg(*sums)
    lines, before = [], F.col("_rows")
    for number, step in enumerate(STEPS, 1):
        left = F.col(f"r_{step}")
        lines.append(
            F.struct(
                F.lit(number).alias("number"),
                F.lit(step).alias("step"),
                F.col(f"m_{step}").alias("missing"),
                F.col(f"f_{step}").alias("filled"),
                (F.col(f"m_{step}") - F.col(f"f_{step}")).alias("missing_after"),
                (before - left).alias("rows_dropped"),
                left.alias("rows_left"),
                (left / F.nullif(F.col("_rows"), F.lit(0)) * 100).alias("percent_kept"),
            )
        )
        before = left
    return totals.select(F.inline(F.array(*lines)))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column, one pass."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column", "nulls")


def year_counts(df: DataFrame, ts: str, tz: str = MARKET_ZONE) -> DataFrame:
    return df.groupBy(F.year(F.from_utc_timestamp(ts, tz)).alias("year")).agg(F.count(F.lit(1)).alias("rows"))
