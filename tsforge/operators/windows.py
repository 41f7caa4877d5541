"""History/horizon windows around local midnights.

How a window is built: rows become one block per local day, blocks are copied into the
28-day buckets that look at them (8 days back, 1 ahead, so 1.3 copies on average), and one
exchange on ``(series, bucket)`` serves both the day grouping and a frame over ten day
blocks per anchor. The eightfold overlap of windows exists only in the output; it is never
shuffled, and a task holds about 37 days of a series, however long the series is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.constants import HISTORY_HOURS, HORIZON_HOURS, HOUR, MARKET_ZONE, STRIDE_HOURS
from tsforge.functions import ordered
from tsforge.functions.columns import add_hours, local_midnight, parse_dmy
from tsforge.operators.clean import dedupe_first

BUCKET_DAYS = 28


def delta_stats(df: DataFrame, series: Sequence[str], ts: str) -> DataFrame:
    """Mean, least and greatest gap in seconds between consecutive rows, per series."""
    return (
        _deltas(df, series, ts)
        .groupBy(*series)
        .agg(
            F.avg("delta").alias("mean_delta"),
            F.min("delta").alias("min_delta"),
            F.max("delta").alias("max_delta"),
            F.count_distinct("delta").alias("distinct_deltas"),
        )
    )


def delta_histogram(df: DataFrame, series: Sequence[str], ts: str) -> DataFrame:
    return _deltas(df, series, ts).groupBy(*series, "delta").agg(F.count(F.lit(1)).alias("occurrences"))


def _deltas(df: DataFrame, series: Sequence[str], ts: str) -> DataFrame:
    rows = ordered.previous_row(df.select(*series, ts), series, ts, [])
    gap = F.unix_seconds(ts) - F.unix_seconds(F.col(f"_previous.{ts}"))
    return rows.where(F.col("_previous").isNotNull()).withColumn("delta", gap)


def with_segments(df: DataFrame, series: Sequence[str], ts: str, gap: int = HOUR) -> DataFrame:
    """Add ``seg``: 0 for the first contiguous run of the series, +1 after each gap longer
    than ``gap`` seconds."""
    seen = ordered.previous_row(df, series, ts, [])
    jump = F.unix_seconds(ts) - F.unix_seconds(F.col(f"_previous.{ts}")) > gap
    flag = F.coalesce(jump, F.lit(False)).cast("long")
    return ordered.running_total(seen, series, ts, flag, "seg").drop("_previous")


def segments(
    df: DataFrame, series: Sequence[str], ts: str, gap: int = HOUR, width: int | ordered.EquiDepth = ordered.BUCKET_SECONDS
) -> DataFrame:
    """``(series, seg, start, end, n)`` of contiguous runs; rows without a stamp are left out.

    Rows are exchanged once, into buckets, and become runs there. A bucket's summary (its first and last run)
    says which runs are open across its edges; summaries of a series, one a bucket, give each run
    its number and each open run its full length. A run comes out of the bucket it starts in.
    """
    keys = [*series, ordered.BUCKET]
    rows = ordered.bucketed(df.select(*series, ts).where(F.col(ts).isNotNull()), ts, width, series)
    inside = ordered.row_window(series, ts)
    jump = F.unix_seconds(ts) - F.lag(F.unix_seconds(ts)).over(inside) > gap
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("_jump", F.coalesce(jump, F.lit(False)).cast("long"))
    runs = (
        numbered.withColumn("_run", F.sum("_jump").over(upto))
        .groupBy(*keys, "_run")
        .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))
    )
    first = F.col("_run") == 0
    summary = runs.groupBy(*keys).agg(
        F.max("_run").alias("_top"),
        F.min("start").alias("_start"),
        F.max("end").alias("_end"),
        F.max(F.when(first, F.col("end"))).alias("_first_end"),
        F.max(F.when(first, F.col("n"))).alias("_first_n"),
    )
    each = Window.partitionBy(*series).orderBy(ordered.BUCKET)
    before = each.rowsBetween(Window.unboundedPreceding, -1)
    so_far = each.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = each.rowsBetween(1, Window.unboundedFollowing)
    rest = each.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # A bucket whose first run goes on from the bucket before; one in which another run starts.
    goes_on = F.unix_seconds("_start") - F.unix_seconds(F.lag("_end").over(each)) <= gap
    summary = summary.withColumn("_joined", F.coalesce(goes_on, F.lit(False)))
    starts = ~F.col("_joined") | (F.col("_top") > 0)
    carried = summary.withColumns(
        {
            "_offset": F.coalesce(F.sum(F.col("_top") + 1).over(before), F.lit(0))
            - F.sum(F.col("_joined").cast("long")).over(so_far),
            "_joined_n": F.sum(F.when(F.col("_joined"), F.col("_first_n")).otherwise(0)).over(so_far),
            "_joined_end": F.last(F.when(F.col("_joined"), F.col("_first_end")), ignorenulls=True).over(so_far),
        }
    )
    # An open run ends in the next bucket in which another one starts, or with the series.
    def there(c):
        return F.coalesce(
            F.first(F.when(starts, F.struct(F.col(c).alias("v"))), ignorenulls=True).over(later),
            F.last(F.struct(F.col(c).alias("v"))).over(rest),
        )["v"]

    carried = carried.withColumns(
        {"_more": there("_joined_n") - F.col("_joined_n"), "_until": there("_joined_end")}
    ).select(*keys, "_offset", "_joined", "_top", "_more", "_until")
    last = F.col("_run") == F.col("_top")
    return (
        runs.join(carried, keys)
        .where(~(first & F.col("_joined")))
        .select(
            *series,
            (F.col("_offset") + F.col("_run")).alias("seg"),
            "start",
            F.when(last, F.greatest("end", "_until")).otherwise(F.col("end")).alias("end"),
            F.when(last, F.col("n") + F.col("_more")).otherwise(F.col("n")).alias("n"),
        )
    )


def day_anchors(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    tz: str = MARKET_ZONE,
    history: int = HISTORY_HOURS,
    horizon: int = HORIZON_HOURS,
) -> DataFrame:
    """Local midnights usable as a forecast origin in each segment: ``history`` hours after
    its start or later and ``horizon`` hours before its end or earlier."""
    runs = segments(df, series, ts).where(F.col("n") >= history + horizon)
    earliest = add_hours("start", history)
    latest = add_hours("end", -horizon)
    local = [F.date_trunc("day", F.from_utc_timestamp(x, tz)) for x in (earliest, latest)]
    days = F.when(local[0] <= local[1], F.sequence(local[0], local[1], F.expr("INTERVAL 1 DAY")))
    return (
        runs.select(*series, "seg", earliest.alias("_lo"), latest.alias("_hi"), F.explode(days).alias("_day"))
        .withColumn("anchor", F.to_utc_timestamp("_day", tz))
        .where(F.col("anchor").between(F.col("_lo"), F.col("_hi")))
        .select(*series, "seg", "anchor")
    )


def _day_number(ts, tz: str):
    return F.datediff(F.to_date(F.from_utc_timestamp(ts, tz)), F.lit("1970-01-01").cast("date"))


def _day_frames(rows: DataFrame, series: Sequence[str], ts: str, tz: str, before: int, after: int) -> DataFrame:
    """One row per series and local day: ``anchor`` and ``frame``, the ``_row`` structs of
    the days from ``before`` earlier to ``after`` later, in time order."""
    day, bucket = F.col("_day"), ordered.BUCKET
    numbered = rows.withColumn("_day", _day_number(ts, tz))
    copies = F.sequence(
        F.floor((day - after) / F.lit(BUCKET_DAYS)), F.floor((day + before) / F.lit(BUCKET_DAYS))
    )
    placed = numbered.withColumn(bucket, F.explode(copies)).repartition(*series, bucket)
    blocks = placed.groupBy(*series, bucket, "_day").agg(
        F.sort_array(F.collect_list("_row")).alias("_block"), F.min(ts).alias("_first")
    )
    near = Window.partitionBy(*series, bucket).orderBy("_day").rangeBetween(-before, after)
    return (
        blocks.withColumn("frame", F.flatten(F.collect_list("_block").over(near)))
        .where(F.col(bucket) == F.floor(day / F.lit(BUCKET_DAYS)))
        .select(*series, "_day", local_midnight("_first", tz).alias("anchor"), "frame")
    )


def window_candidates(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    past: Sequence[str],
    future: Sequence[str],
    target: str,
    tz: str = MARKET_ZONE,
    history: int = HISTORY_HOURS,
    horizon: int = HORIZON_HOURS,
    stride: int = STRIDE_HOURS,
    require_end: bool = True,
    dedupe: bool = True,
) -> DataFrame:
    """Every local day of every series with its would-be window and a ``status``:
    ``complete``, ``missing_stamp`` (no row at the anchor or, with ``require_end``, none at
    its end), ``missing_rows`` (not exactly the hours wanted) or ``missing_data`` (a null).

    ``dedupe=False`` saves an exchange when ``(series, ts)`` is known to be unique.
    """
    if stride % 24:
        raise ValueError("stride must be whole days")
    used = list(dict.fromkeys([*past, *future, target]))
    rows = df.select(*series, ts, *used)
    if dedupe:
        rows = dedupe_first(rows, [*series, ts])

    def known(columns):
        ok = F.lit(True)
        for c in columns:
            ok = ok & F.col(c).isNotNull()
        return ok

    row = F.struct(
        F.col(ts).alias("ts"),
        known(past).alias("past_ok"),
        known([*future, target]).alias("future_ok"),
        *[F.col(c) for c in used],
    )
    before, after = math.ceil(history / 24) + 1, math.ceil(horizon / 24)
    days = _day_frames(rows.select(*series, ts, row.alias("_row")), series, ts, tz, before, after)
    if stride != 24:
        # Origins are counted in local days from the first day of each series.
        first = days.groupBy(*series).agg(F.min("_day").alias("_origin"))
        days = ordered.spread_join(days, first, series, "_day")
        days = days.where(F.pmod(F.col("_day") - F.col("_origin"), F.lit(stride // 24)) == 0)
    start, stop = add_hours("anchor", -history), add_hours("anchor", horizon)
    cut = days.select(
        *series,
        "anchor",
        F.filter("frame", lambda r: (r.ts >= start) & (r.ts < F.col("anchor"))).alias("_past"),
        F.filter("frame", lambda r: (r.ts >= F.col("anchor")) & (r.ts < stop)).alias("_future"),
        F.exists("frame", lambda r: r.ts == stop).alias("_end"),
    )
    at_anchor = F.coalesce(F.try_element_at("_future", F.lit(1))["ts"] == F.col("anchor"), F.lit(False))
    stamped = at_anchor & F.col("_end") if require_end else at_anchor
    whole = (F.size("_past") == history) & (F.size("_future") == horizon)
    filled = F.forall("_past", lambda r: r.past_ok) & F.forall("_future", lambda r: r.future_ok)
    return cut.select(
        *series,
        "anchor",
        add_hours("anchor", 12).alias("window_date"),
        F.transform("_past", lambda r: F.struct(r.ts.alias("ts"), *[r[c].alias(c) for c in past])).alias("past"),
        F.transform("_future", lambda r: F.struct(r.ts.alias("ts"), *[r[c].alias(c) for c in future])).alias("future"),
        F.transform("_future", lambda r: r[target].cast("double")).alias("y"),
        F.when(~stamped, "missing_stamp")
        .when(~whole, "missing_rows")
        .when(~filled, "missing_data")
        .otherwise("complete")
        .alias("status"),
    )


def make_windows(df: DataFrame, series, ts, past, future, target, **options) -> DataFrame:
    """Complete windows: ``past`` (168 structs before the anchor), ``future`` (24 structs
    from it), ``y`` and ``window_date``. Options as in ``window_candidates``."""
    found = window_candidates(df, series, ts, past, future, target, **options)
    return found.where(F.col("status") == "complete").drop("status")


def window_rejects(candidates: DataFrame, series: Sequence[str]) -> DataFrame:
    """How many candidate windows of each series ended in each status."""
    return candidates.groupBy(*series, "status").agg(F.count(F.lit(1)).alias("windows"))


def window_spacing(windows: DataFrame, series: Sequence[str], anchor: str = "anchor") -> DataFrame:
    """Histogram of seconds between consecutive window starts, with the overall figures."""
    starts = windows.select(*series, anchor)
    histogram = delta_histogram(starts, series, anchor)
    n = F.col("occurrences")
    each = Window.partitionBy(*series)
    return histogram.withColumns(
        {
            "mean_delta": F.sum(F.col("delta") * n).over(each) / F.sum(n).over(each),
            "min_delta": F.min("delta").over(each),
            "max_delta": F.max("delta").over(each),
        }
    )


def windows_between(
    windows: DataFrame, start: str, end: str, tz: str = MARKET_ZONE, date: str = "window_date"
) -> DataFrame:
    """Windows whose date lies in local ``[start 00:00:00, end 23:59:59]``; ``dd/MM/yyyy``."""
    lo = parse_dmy(F.lit(start), tz)
    hi = F.to_utc_timestamp(
        F.try_to_timestamp(F.lit(f"{end} 23:59:59"), F.lit("dd/MM/yyyy HH:mm:ss")), tz
    )
    return windows.where(F.col(date).between(lo, hi))


def request_windows(
    requests: DataFrame,
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    past: Sequence[str],
    future: Sequence[str],
    target: str,
    day: str = "target_date",
    tz: str = MARKET_ZONE,
    history: int = HISTORY_HOURS,
    horizon: int = HORIZON_HOURS,
) -> DataFrame:
    """For each requested local midnight and series: the last ``history`` rows of the week
    before, the first ``horizon`` rows of the day, the day's actuals and a ``status``
    (``ok``, ``short_past``, ``short_future``; a date no series has rows for is ``no_data``).

    History is absolute time: after a 23-hour day the last ``history`` hours reach into one
    more local day, after a 25-hour day they end an hour short of a week of local days. The
    request is widened to the local days it may need and joined to the rows by day, so rows
    no request asks for are dropped by the join.
    """
    used = list(dict.fromkeys([*past, *future, target]))
    days_back = math.ceil(history / 24) + 1
    rows = df.select(*series, ts, *used).withColumn("_day", _day_number(ts, tz))
    asked = requests.select(day).distinct()
    number = _day_number(F.col(day), tz)
    wanted = asked.select(
        day, F.explode(F.sequence(number - days_back, number + math.ceil(horizon / 24) - 1)).alias("_day")
    )
    row = F.struct(F.col(ts).alias("ts"), *[F.col(c) for c in used])
    recent = F.unix_seconds(ts) >= F.unix_seconds(day) - history * HOUR
    grouped = (
        dedupe_first(rows.join(wanted, "_day").where(recent).drop("_day"), [day, *series, ts])
        .groupBy(day, *series)
        .agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    )
    before = F.filter("_rows", lambda r: r.ts < F.col(day))
    onward = F.filter("_rows", lambda r: r.ts >= F.col(day))
    cut = grouped.select(
        day,
        *series,
        F.when(F.size(before) > history, F.slice(before, -history, history)).otherwise(before).alias("_past"),
        F.slice(onward, 1, horizon).alias("_future"),
    )
    status = (
        F.when(F.size("_past") < history, "short_past")
        .when(F.size("_future") < horizon, "short_future")
        .otherwise("ok")
    )
    found = cut.select(
        day,
        *series,
        F.transform("_past", lambda r: F.struct(r.ts.alias("ts"), *[r[c].alias(c) for c in past])).alias("past"),
        F.transform("_future", lambda r: F.struct(r.ts.alias("ts"), *[r[c].alias(c) for c in future])).alias("future"),
        F.transform("_future", lambda r: r[target].cast("double")).alias("actual"),
        status.alias("status"),
    )
    return asked.join(found, day, "left").withColumn("status", F.coalesce("status", F.lit("no_data")))


def stack_hours(
    windows: DataFrame, keys: Sequence[str], arrays: Sequence[str] = ("y",), hour: str = "hour"
) -> DataFrame:
    """One row per window and horizon hour, with the element of each array."""
    zipped = F.arrays_zip(*[F.col(a).alias(a) for a in arrays])
    exploded = windows.select(*keys, F.posexplode(zipped).alias(hour, "_v"))
    return exploded.select(*keys, hour, *[F.col(f"_v.{a}").alias(a) for a in arrays])
