"""Leakage-safe splits, folds and seeded shuffles.

Splits are decided per series, from ranks computed in two passes (bucket counts, then ranks
inside buckets) and a handful of boundary values per series joined back with a salt, so no
step orders a whole series in one task. A window is identified by ``(series, anchor)``; its
first past hour and last future hour follow from the anchor because it is complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.constants import (
    FOLDS,
    GAP_HOURS,
    HISTORY_HOURS,
    HORIZON_HOURS,
    HOUR,
    MARKET_ZONE,
    ROW_GAP,
    TEST_FRACTION,
    TEST_YEAR,
    VAL_FRACTION,
    VAL_YEAR,
)
from tsforge.functions import ordered


def anchor_gap(gap: int = GAP_HOURS, history: int = HISTORY_HOURS, horizon: int = HORIZON_HOURS) -> int:
    """Seconds between the anchors of two windows whose ``first past hour`` and ``last
    future hour`` are ``gap`` hours apart."""
    return (gap + history + horizon - 1) * HOUR


def _share(total: Column, fraction: float) -> Column:
    """``int(total * fraction)`` without binary dust: 0.2 of 10 rows is 2."""
    return F.floor(F.round(total * F.lit(fraction), 9)).cast("long")


def split_fraction_rows(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    val: float = VAL_FRACTION,
    test: float = TEST_FRACTION,
    gap: int = ROW_GAP,
    ties: Sequence[str] = (),
    width: int | ordered.EquiDepth = ordered.BUCKET_SECONDS,
) -> DataFrame:
    """Chronological train/val/test by row; the first ``gap`` rows of val and test go."""
    ranked = ordered.rank_in_series(df, series, ts, ties, width=width)
    n_test, n_val = _share(F.col("_n"), test), _share(F.col("_n"), val)
    n_train = F.col("_n") - n_test - n_val
    rank = F.col("_rank")
    split = (
        F.when(rank <= n_train, "train")
        .when((rank > n_train + gap) & (rank <= n_train + n_val), "val")
        .when(rank > n_train + n_val + gap, "test")
    )
    return ranked.withColumn("split", split).where(F.col("split").isNotNull()).drop("_rank", "_n")


def split_fraction_gap(
    windows: DataFrame,
    series: Sequence[str],
    anchor: str = "anchor",
    val: float = VAL_FRACTION,
    test: float = TEST_FRACTION,
    gap: int | None = None,
) -> DataFrame:
    """Chronological split by window. Validation takes its number of windows from the first
    one far enough after training; test takes all windows far enough after validation.

    The boundaries of a series are stamps, found in its bucket index, and joined back once; anchors of a
    series are distinct.
    """
    far = 1_000_000 * (anchor_gap() if gap is None else gap)
    n = F.col("_n")
    n_val = _share(n, val)
    n_train = n - _share(n, test) - n_val
    found = ordered.bucket_index(windows, series, anchor)
    found = found.withColumn("_train_end", ordered.stamp_at(series, n_train))
    found = found.withColumn("_first", ordered.rank_from(series, F.col("_train_end") + far))
    first = F.when(F.col("_first").isNotNull(), F.greatest("_first", n_train + 1))
    found = found.withColumns(
        {
            "_val_start": ordered.stamp_at(series, first),
            "_val_end": ordered.stamp_at(series, F.when(first.isNotNull(), F.least(first + n_val - 1, n))),
        }
    )
    bounds = found.groupBy(*series).agg(*[F.first(c).alias(c) for c in ("_train_end", "_val_start", "_val_end")])
    at = F.unix_micros(anchor)
    split = (
        F.when(at <= F.col("_train_end"), "train")
        .when((at >= F.col("_val_start")) & (at <= F.col("_val_end")), "val")
        .when((at > F.col("_val_end")) & (at >= F.col("_val_end") + far), "test")
    )
    placed = ordered.spread_join(windows, bounds, series, anchor)
    return placed.withColumn("split", split).where(F.col("split").isNotNull()).select(*windows.columns, "split")


def split_calendar(
    windows: DataFrame,
    series: Sequence[str],
    anchor: str = "anchor",
    date: str = "window_date",
    val_year: int = VAL_YEAR,
    test_year: int = TEST_YEAR,
    tz: str = MARKET_ZONE,
    gap: int | None = None,
) -> DataFrame:
    """Before, in and after the validation year, by the local year of the window date, with
    the same gap. A split that never reaches the gap is empty."""
    far = anchor_gap() if gap is None else gap
    year, at = F.year(F.from_utc_timestamp(date, tz)), F.unix_seconds(anchor)
    split = (
        F.when(year < val_year, "train").when(year == val_year, "val").when(year == test_year, "test")
    )
    dated = windows.withColumn("split", split).where(F.col("split").isNotNull())
    slim = dated.select(*series, "split", at.alias("_at"))
    train_end = slim.where("split = 'train'").groupBy(*series).agg(F.max("_at").alias("_train_end"))
    # The last validation window is the last of its year unless the gap empties the split.
    val_end = slim.where("split = 'val'").groupBy(*series).agg(F.max("_at").alias("_val_last"))
    bounds = train_end.join(val_end, list(series), "full").withColumn(
        "_val_end",
        F.when(F.col("_train_end").isNull() | (F.col("_val_last") >= F.col("_train_end") + far), F.col("_val_last")),
    )
    placed = ordered.spread_join(dated, bounds, series, anchor)
    late = (
        F.when(F.col("split") == "val", F.col("_train_end").isNull() | (at >= F.col("_train_end") + far))
        .when(F.col("split") == "test", F.col("_val_end").isNull() | (at >= F.col("_val_end") + far))
        .otherwise(True)
    )
    return placed.where(late).select(*windows.columns, "split")


def folds_expanding(
    windows: DataFrame,
    series: Sequence[str],
    anchor: str = "anchor",
    folds: int = FOLDS,
    val: float = VAL_FRACTION,
    test: float = TEST_FRACTION,
    gap: int | None = None,
) -> DataFrame:
    """Hold out the last ``test`` share (fold 0, split ``test``); fold ``i`` is the first
    ``i/folds`` of the rest, its last ``val`` share validation, both after a gap.

    A window comes out once per fold that uses it. The fold list is a literal array, and the boundaries of a
    series are stamps, found in its bucket index and joined back once; anchors of a series are distinct.
    """
    far = 1_000_000 * (anchor_gap() if gap is None else gap)
    n, at = F.col("_n"), F.unix_micros(anchor)
    n_test = _share(n, test)
    n_rest = n - n_test
    size = [F.lit(i) * F.floor(n_rest / folds) for i in range(1, folds + 1)]
    n_train = [s - _share(s, val) for s in size]
    found = ordered.bucket_index(windows, series, anchor)
    stamps = {"_end_0": n_rest}
    for i in range(1, folds + 1):
        stamps |= {f"_end_{i}": n_train[i - 1], f"_size_{i}": size[i - 1]}
    found = found.withColumns({name: ordered.stamp_at(series, rank) for name, rank in stamps.items()})
    # The test set starts at the first window after the gap and is as long as planned.
    found = found.withColumn("_first", ordered.rank_from(series, F.col("_end_0") + far))
    first = F.when(F.col("_first").isNotNull(), F.greatest("_first", n_rest + 1))
    found = found.withColumns(
        {
            "_test_start": ordered.stamp_at(series, first),
            "_test_end": ordered.stamp_at(series, F.when(first.isNotNull(), F.least(first + n_test - 1, n))),
        }
    )
    bounds = found.groupBy(*series).agg(*[F.first(c).alias(c) for c in (*stamps, "_test_start", "_test_end")])
    placed = ordered.spread_join(windows, bounds, series, anchor)
    tested = (at >= F.col("_test_start")) & (at <= F.col("_test_end"))
    roles = [F.struct(F.lit(0).alias("fold"), F.when(tested, F.lit("test")).alias("split"))]
    for i in range(1, folds + 1):
        end = F.col(f"_end_{i}")
        roles.append(
            F.struct(
                F.lit(i).alias("fold"),
                F.when(at <= end, F.lit("train"))
                .when((at <= F.col(f"_size_{i}")) & (at > end) & (at >= end + far), F.lit("val"))
                .alias("split"),
            )
        )
    return (
        placed.withColumn("_role", F.explode(F.filter(F.array(*roles), lambda r: r.split.isNotNull())))
        .select(*windows.columns, F.col("_role.fold").alias("fold"), F.col("_role.split").alias("split"))
    )


def full_set(windows: DataFrame) -> DataFrame:
    """All windows as one training set."""
    return windows.withColumn("split", F.lit("train"))


def shuffle_across(
    df: DataFrame,
    ids: Sequence[str],
    seed: int = 0,
    split: str = "split",
    order=("train", "val", "test"),
    draw: Column | None = None,
) -> DataFrame:
    """Pool the splits, permute, and cut again to the original sizes. Seeded: the same rows
    get the same places whatever the partitioning. ``draw`` is a 64-bit number of a row to order by in place of
    the seeded hash of ``ids``."""
    ranked = ordered.rank_by_hash(df, [], ids, seed, draw=draw)
    # The sizes are one row of three counts.
    sizes = df.agg(F.struct(*[F.count_if(F.col(split) == s).alias(s) for s in order]).alias("n"))
    counts = sizes.scalar()
    stop, new = F.lit(0), F.lit(None).cast("string")
    edges = []
    for name in order:
        stop = stop + F.col("_sizes")[name]
        edges.append((stop, name))
    for edge, name in reversed(edges):
        new = F.when(F.col("_rank") <= edge, F.lit(name)).otherwise(new)
    return (
        ranked.withColumn("_sizes", counts)
        .withColumn(split, new)
        .withColumn("position", F.col("_rank"))
        .drop("_rank", "_n", "_sizes")
    )


def shuffle_within(
    df: DataFrame, ids: Sequence[str], seed: int = 0, split: str = "split", draw: Column | None = None
) -> DataFrame:
    """Permute inside each split: ``position`` is the new place, from 1. ``draw`` as in ``shuffle_across``."""
    return ordered.rank_by_hash(df, [split], ids, seed, rank="position", draw=draw).drop("_n")


def random_split(
    df: DataFrame, ids: Sequence[str], percent: int = 80, seed: int = 0, draw: Column | None = None
) -> DataFrame:
    """Train with probability ``percent`` %, decided by the row's identity alone. ``draw`` as in ``shuffle_across``."""
    number = F.xxhash64(*ids, F.lit(seed)) if draw is None else draw
    return df.withColumn("split", F.when(F.pmod(number, F.lit(100)) < percent, "train").otherwise("test"))


def md5_draw(ids: Sequence[str], seed: int = 0) -> Column:
    """A 60-bit draw, the first 15 hex digits of the MD5 of ``seed|id|id…``, which other engines can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def kfold(df: DataFrame, series: Sequence[str], ts: str, folds: int = FOLDS, ties: Sequence[str] = ()) -> DataFrame:
    """Unshuffled folds: contiguous blocks of row order whose sizes differ by at most one,
    the longer ones first."""
    ranked = ordered.rank_in_series(df, series, ts, ties)
    small = F.floor(F.col("_n") / folds)
    longer = F.col("_n") - small * folds
    place = F.col("_rank") - 1
    head = longer * (small + 1)
    fold = F.when(place < head, F.floor(place / (small + 1))).otherwise(
        longer + F.floor((place - head) / F.greatest(small, F.lit(1)))
    )
    return ranked.withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def split_report(
    df: DataFrame,
    keys: Sequence[str] = ("split",),
    date: str = "window_date",
    anchor: str = "anchor",
    tz: str = MARKET_ZONE,
    history: int = HISTORY_HOURS,
    horizon: int = HORIZON_HOURS,
) -> DataFrame:
    """Per split: size, first and last date, first and last year, and the first past and
    last future hour, from which gaps between splits follow."""
    year = F.year(F.from_utc_timestamp(date, tz))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        (F.min(F.unix_seconds(anchor)) - history * HOUR).alias("first_past"),
        (F.max(F.unix_seconds(anchor)) + (horizon - 1) * HOUR).alias("last_future"),
    )


def split_gaps(report: DataFrame) -> DataFrame:
    """Hours between the end of train and the start of val, and val and test. The report
    has three rows, so this is one small aggregate."""
    pick = {
        (s, c): F.max(F.when(F.col("split") == s, F.col(c)))
        for s in ("train", "val", "test")
        for c in ("first_past", "last_future")
    }
    return report.agg(
        ((pick["val", "first_past"] - pick["train", "last_future"]) / HOUR).alias("train_val_gap"),
        ((pick["test", "first_past"] - pick["val", "last_future"]) / HOUR).alias("val_test_gap"),
    )
