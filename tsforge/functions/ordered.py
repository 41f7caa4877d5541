"""Order-aware steps that never put a whole series into one task.

``Window.partitionBy(series).orderBy(ts)`` sends a series to a single task, and one series
may hold a third of all rows. Everything here cuts a series into fixed time buckets first:

* bounded frames (``with_context``) copy the rows a bucket needs from its neighbours, then
  any window function may run over ``(series, bucket)``;
* unbounded frames (fill, running total, rank, previous row) run inside each bucket and
  take what crosses the edge from a per-bucket summary. A series has one summary row per
  bucket of calendar time it touches (13 a year by default), however many rows it has, so
  the window over summaries is bounded by the calendar.

Buckets are a function of the timestamp alone: a re-run task rebuilds the same rows. Where a series has bursts,
``EquiDepth`` in place of a width cuts dense buckets on by their row counts, for the unbounded steps.
Series columns must not be null, and ``(series, ts)`` must be unique (see
``clean.mean_duplicates``) unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 28 * 86400
BUCKET = "_bucket"
OWN = "_own"


def bucket_no(seconds: Column, width: int = BUCKET_SECONDS) -> Column:
    """Number of the time bucket that holds an epoch second."""
    return F.floor(seconds / F.lit(width)).cast("long")


@dataclass(frozen=True)
class EquiDepth:
    """Buckets of ``width`` seconds, and those of them with more than ``rows`` rows of a series cut on into as many
    parts as they need, ``PARTS`` at most, of about equal row counts. For series with bursts: a burst of a minute
    becomes as many buckets as its rows need. Rows of one stamp stay together."""

    rows: int = 1_000_000
    width: int = BUCKET_SECONDS


#: Parts of one bucket of time at most, and ranks that a sketch of its stamps tells apart.
PARTS, SKETCH = 1024, 20_000


def bucketed(df: DataFrame, ts: str, width: int | EquiDepth = BUCKET_SECONDS, series: Sequence[str] = ()) -> DataFrame:
    """Add the number of the bucket of each row; later rows have the same or a later bucket.

    With ``EquiDepth`` a first pass counts the rows of each bucket and sketches their stamps; the cuts of the dense
    ones, a small table, are joined to the rows.
    """
    if not isinstance(width, EquiDepth):
        return df.withColumn(BUCKET, bucket_no(F.unix_seconds(ts), width))
    keys, at = [*series, BUCKET], F.unix_micros(ts)
    timed = df.withColumn(BUCKET, bucket_no(F.unix_seconds(ts), width.width))
    shares = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    counted = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_held"), F.percentile_approx(at, shares, F.lit(SKETCH)).alias("_ranks")
    )
    # Every so manieth of the sketched stamps is a cut.
    stride = F.greatest(F.floor(F.lit(PARTS) * width.rows / F.col("_held")), F.lit(1))
    dense = counted.where(F.col("_held") > width.rows).select(
        *keys, F.array_distinct(F.filter("_ranks", lambda _, i: (i + 1) % stride == 0)).alias("_cuts")
    )
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= at)), F.lit(0))
    cut = timed.join(dense, keys, "left")
    return cut.withColumn(BUCKET, F.col(BUCKET) * PARTS + F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts")


def with_context(
    df: DataFrame,
    ts: str,
    before: int,
    after: int,
    width: int = BUCKET_SECONDS,
) -> DataFrame:
    """Copy each row into every bucket whose rows look back ``before`` or ahead ``after``
    seconds to it. ``_own`` marks the one copy that belongs to its bucket: keep only those
    after the window functions. Rows grow by ``1 + (before + after) / width``."""
    now = F.unix_seconds(ts)
    return df.withColumn(
        BUCKET,
        F.explode(
            F.sequence(bucket_no(now - F.lit(after), width), bucket_no(now + F.lit(before), width))
        ),
    ).withColumn(OWN, F.col(BUCKET) == bucket_no(now, width))


def range_window(series: Sequence[str], ts: str):
    """Window over one bucket of a series, ordered by epoch seconds for range frames."""
    return Window.partitionBy(*series, BUCKET).orderBy(F.unix_seconds(ts))


def row_window(series: Sequence[str], ts: str, *ties: str):
    return Window.partitionBy(*series, BUCKET).orderBy(ts, *ties)


def _before(series: Sequence[str]):
    over = Window.partitionBy(*series).orderBy(BUCKET)
    return over.rowsBetween(Window.unboundedPreceding, -1)


def _after(series: Sequence[str]):
    over = Window.partitionBy(*series).orderBy(BUCKET)
    return over.rowsBetween(1, Window.unboundedFollowing)


def fill_gaps(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    cols: Sequence[str],
    forward: bool = True,
    backward: bool = False,
    width: int | EquiDepth = BUCKET_SECONDS,
) -> DataFrame:
    """Null -> last known value in time order, then (``backward``) the next known one."""
    keys = [*series, BUCKET]
    rows = bucketed(df, ts, width, series)
    known = {c: F.when(F.col(c).isNotNull(), F.col(ts)) for c in cols}
    summary = rows.groupBy(*keys).agg(
        *[F.max_by(c, known[c]).alias(f"_last_{c}") for c in cols],
        *[F.min_by(c, known[c]).alias(f"_first_{c}") for c in cols if backward],
    )
    carried = summary.select(
        *keys,
        *[F.last(f"_last_{c}", ignorenulls=True).over(_before(series)).alias(f"_prev_{c}") for c in cols],
        *[
            F.first(f"_first_{c}", ignorenulls=True).over(_after(series)).alias(f"_next_{c}")
            for c in cols
            if backward
        ],
    )
    inside = row_window(series, ts)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = {}
    for c in cols:
        options = [F.col(c)]
        if forward:
            options += [F.last(c, ignorenulls=True).over(upto), F.col(f"_prev_{c}")]
        if backward:
            options += [F.first(c, ignorenulls=True).over(onward), F.col(f"_next_{c}")]
        filled[c] = F.coalesce(*options).alias(c)
    return rows.join(carried, keys, "left").select(*[filled.get(c, F.col(c)) for c in df.columns])


def previous_row(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    cols: Sequence[str],
    out: str = "_previous",
    width: int | EquiDepth = BUCKET_SECONDS,
) -> DataFrame:
    """Add ``out``: a struct of ``ts`` and ``cols`` of the row before, null on the first."""
    keys = [*series, BUCKET]
    rows = bucketed(df, ts, width, series)
    rest = [c for c in cols if c != ts]
    # One max_by per column and not one of a struct: fixed-width buffers aggregate by hash.
    summary = rows.groupBy(*keys).agg(F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in rest])
    me = F.struct(ts, *rest)
    carried = summary.select(*keys, F.lag(me).over(Window.partitionBy(*series).orderBy(BUCKET)).alias("_carried"))
    return (
        rows.join(carried, keys, "left")
        .withColumn(out, F.coalesce(F.lag(me).over(row_window(series, ts)), F.col("_carried")))
        .drop(BUCKET, "_carried")
    )


def running_total(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    value: Column,
    out: str,
    width: int | EquiDepth = BUCKET_SECONDS,
) -> DataFrame:
    """Add ``out``: sum of ``value`` over this row and all earlier rows of the series."""
    keys = [*series, BUCKET]
    rows = bucketed(df.withColumn("_value", value), ts, width, series)
    carried = (
        rows.groupBy(*keys)
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, F.sum("_total").over(_before(series)).alias("_carried"))
    )
    upto = row_window(series, ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(carried, keys, "left")
        .withColumn(out, F.coalesce(F.col("_carried"), F.lit(0)) + F.sum("_value").over(upto))
        .drop(BUCKET, "_carried", "_value")
    )


def rank_in_series(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    rank: str = "_rank",
    total: str = "_n",
    width: int | EquiDepth = BUCKET_SECONDS,
) -> DataFrame:
    """Add a 1-based ``rank`` by ``(ts, ties)`` and the row count ``total`` of the series.

    Two passes: bucket counts give offsets, then ``row_number`` inside the bucket.
    """
    return _ranked(bucketed(df, ts, width, series), series, [ts, *ties], rank, total)


def bucket_index(df: DataFrame, series: Sequence[str], ts: str, width: int = BUCKET_SECONDS) -> DataFrame:
    """One row per series and bucket: ``_at``, its stamps in order (microseconds), ``_offset``, the rows of the
    series before it, and ``_n``, the rows of the series. For sparse rows such as daily forecast origins,
    of which a bucket holds a few.

    ``stamp_at`` and ``rank_from`` find ranks and stamps in it: the bucket that holds a boundary
    follows from the counts, and only that bucket is looked into. All of them share one partitioning.
    """
    stamps = bucketed(df.select(*series, ts), ts, width).groupBy(*series, BUCKET)
    index = stamps.agg(F.sort_array(F.collect_list(F.unix_micros(ts))).alias("_at"))
    held = F.size("_at").cast("long")
    return index.withColumn("_offset", F.coalesce(F.sum(held).over(_before(series)), F.lit(0))).withColumn(
        "_n", F.sum(held).over(Window.partitionBy(*series))
    )


def stamp_at(series: Sequence[str], rank: Column) -> Column:
    """Stamp of the row of a series that has ``rank``, from 1; null beyond its ends."""
    place = F.when(rank > F.col("_offset"), (rank - F.col("_offset") - 1).cast("int"))
    return F.max(F.get("_at", place)).over(Window.partitionBy(*series))


def rank_from(series: Sequence[str], stamp: Column) -> Column:
    """Rank of the first row of a series at ``stamp`` or later; null where there is none."""
    earlier = F.size(F.filter("_at", lambda a: a < stamp))
    first = F.when(earlier < F.size("_at"), F.col("_offset") + earlier + 1)
    return F.min(first).over(Window.partitionBy(*series))


def rank_by_hash(
    df: DataFrame,
    groups: Sequence[str],
    ids: Sequence[str],
    seed: int,
    rank: str = "_rank",
    total: str = "_n",
    bits: int = 16,
    draw: Column | None = None,
) -> DataFrame:
    """Seeded random permutation: rank by ``xxhash64(ids, seed)`` within ``groups``, or by another 64-bit ``draw``.

    Buckets are the leading bits of the hash, so they are even whatever the data are, and
    there are at most ``2**bits`` of them per group. Equal ids must be unique rows.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*ids, F.lit(seed)) if draw is None else draw)
    rows = hashed.withColumn(BUCKET, F.shiftright("_hash", 64 - bits).cast("long"))
    return _ranked(rows, groups, ["_hash", *ids], rank, total).drop("_hash")


def _ranked(rows: DataFrame, groups, order, rank, total) -> DataFrame:
    # One group for the whole table still needs a window key; the constant only keys summaries.
    keys = [*groups, BUCKET]
    each = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    summary = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    before = each.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select(
        *keys,
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"),
        F.sum("_count").over(each).alias(total),
    )
    return (
        # Left, so that a row without a series is handed on unranked and not lost.
        rows.join(offsets, keys, "left")
        .withColumn(
            rank,
            F.col("_offset") + F.row_number().over(Window.partitionBy(*keys).orderBy(*order)),
        )
        .drop(BUCKET, "_offset")
    )


def spread_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], by: str, how: str = "left", copies: int = 16
) -> DataFrame:
    """Join one row per key onto many rows per key without a hot shuffle partition.

    ``big`` gets a salt from column ``by``, ``small`` one copy per salt. When Spark sees
    that ``small`` fits its broadcast limit it broadcasts it and the salt costs nothing.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(copies)).cast("int"))
    copied = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")
