from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tsforge.functions import ordered
from tsforge.operators import features as f
from tsforge.operators import windows as w

S = ["series"]


def _make(df, **options):
    return w.make_windows(df, S, "ts", ["value"], ["value"], "value", **options)


def _brute(rows, require_end=True):
    """Windows of one series by definition, on plain Python lists."""
    from zoneinfo import ZoneInfo

    paris, utc = ZoneInfo("Europe/Paris"), ZoneInfo("UTC")
    at = {t: v for t, v in rows}
    days = {t.replace(tzinfo=utc).astimezone(paris).date() for t in at}
    out = {}
    for day in days:
        a = datetime(day.year, day.month, day.day, tzinfo=paris).astimezone(utc).replace(tzinfo=None)
        past = [at.get(a - timedelta(hours=h)) for h in range(168, 0, -1)]
        y = [at.get(a + timedelta(hours=h)) for h in range(24)]
        if None not in past and None not in y and (not require_end or a + timedelta(hours=24) in at):
            out[a] = (past, y)
    return out


@pytest.mark.parametrize("start", ["2024-03-18", "2024-10-15", "2024-01-20"])
def test_windows_equal_the_definition_across_clock_changes(spark, hours, start):
    df = hours(start, 24 * 26, skip={300})
    want = _brute([(r.ts, r.value) for r in df.collect()])
    got = {r.anchor: ([x.value for x in r.past], r.y) for r in _make(df).collect()}
    assert got == want and len(got) > 5


def test_end_stamp(spark, hours):
    eight_days = hours("2023-12-31 23:00:00", 192)
    assert _make(eight_days).count() == 0
    assert _make(eight_days, require_end=False).count() == 1
    assert _make(hours("2023-12-31 23:00:00", 193)).count() == 1


def test_null_duplicate_and_status(spark, hours):
    df = hours("2024-01-01", 24 * 20, lambda i: None if i == 200 else float(i))
    twice = df.unionByName(df)
    assert _make(twice).collect() == _make(df).collect()
    found = w.window_candidates(df, S, "ts", ["value"], ["value"], "value")
    counts = {r.status: r.windows for r in w.window_rejects(found, S).collect()}
    assert counts["missing_data"] == 8  # its own day and the seven histories that hold it
    assert sum(counts.values()) == found.count()


def test_windows_do_not_depend_on_partitioning(spark, hours):
    df = hours("2024-01-01", 24 * 40).unionByName(hours("2024-01-05", 24 * 40, series="B"))
    first = sorted(map(str, _make(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, _make(df.repartition(5)).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_stride_of_two_days(spark, hours):
    df = hours("2024-01-01", 24 * 30)
    every, second = _make(df).count(), _make(df, stride=48).count()
    assert second in (every // 2, every // 2 + 1)
    with pytest.raises(ValueError):
        _make(df, stride=36)


def test_one_scan_and_no_single_partition(spark):
    df = spark.read.schema("event_type STRING, ts TIMESTAMP, value DOUBLE").parquet("/root/testdata/sf0.001/events.parquet")
    rows = df.groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))
    plan = _make(rows, dedupe=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # the hourly mean and the windows


def test_segments_and_anchors(spark, hours):
    df = hours("2024-01-01", 24 * 30, skip={500}).unionByName(hours("2024-01-01", 100, series="B"))
    got = {(r.series, r.seg): r.n for r in w.segments(df, S, "ts").collect()}
    assert got == {("A", 0): 500, ("A", 1): 219, ("B", 0): 100}
    anchors = [r.anchor for r in w.day_anchors(df, S, "ts").orderBy("anchor").collect()]
    # 2024-01-08 00:00 UTC is 01:00 in Paris, so the first local midnight is that evening.
    assert anchors[0] == datetime(2024, 1, 8, 23)
    assert all(a.hour == 23 for a in anchors)


def test_deltas_across_buckets(spark, hours):
    df = hours("2024-01-01", 2000, skip=set(range(700, 760)))
    row = w.delta_stats(df, S, "ts").first()
    assert (row.min_delta, row.max_delta, row.distinct_deltas) == (3600, 61 * 3600, 2)


def test_lags_are_by_time(spark, hours):
    df = hours("2024-01-01", 1000, skip={30, 700})
    got = {int(r.value): r for r in f.time_lags(df, S, "ts", "value", [1, 24, 96]).collect()}
    assert got[54].value_lag_24h is None and got[31].value_lag_1h is None
    assert got[701].value_lag_1h is None and got[680].value_lag_96h == 584.0
    assert all(r.value_lag_24h in (None, v - 24.0) for v, r in got.items())
    assert f.drop_incomplete_lags(f.time_lags(df, S, "ts", "value", [1, 24, 96])).count() == (1000 - 96 - 1) - 4
    with pytest.raises(ValueError):
        f.drop_incomplete_lags(f.time_lags(df, S, "ts", "value", [5000]), require_rows=True)
    frames = f.time_lags(df, S, "ts", "value", [1, 24, 96], step=None)
    assert sorted(map(str, frames.collect())) == sorted(map(str, got.values()))


def test_lags_refuse_rows_off_the_grid(spark, hours):
    off = hours("2024-01-01 00:20:00", 5)
    with pytest.raises(Exception, match="off the 3600 s grid"):
        f.time_lags(off, S, "ts", "value", [1]).collect()
    with pytest.raises(Exception, match="repeated"):
        f.time_lags(hours("2024-01-01", 5).unionByName(hours("2024-01-01", 1)), S, "ts", "value", [1]).collect()
    assert f.time_lags(off, S, "ts", "value", [1], step=None).where("value_lag_1h is not null").count() == 4


def test_requests_have_a_status(spark, hours):
    df = hours("2023-12-31 23:00:00", 24 * 10)
    days = [datetime(2024, 1, 3, 23), datetime(2024, 1, 8, 23), datetime(2024, 1, 10, 23), datetime(2020, 1, 1, 23)]
    requests = spark.createDataFrame([(d,) for d in days], "target_date TIMESTAMP")
    got = {r.target_date: r for r in w.request_windows(requests, df, S, "ts", ["value"], ["value"], "value").collect()}
    assert [got[d].status for d in days] == ["short_past", "ok", "short_future", "no_data"]
    assert len(got[days[1]].past) == 168 and got[days[1]].actual[0] == 24.0 * 8


@pytest.mark.parametrize("start, first, days", [("2024-03-10", datetime(2024, 3, 25), 17), ("2024-10-12", datetime(2024, 10, 25), 14)])
def test_requests_hold_a_week_of_hours_around_clock_changes(spark, hours, start, first, days):
    df = hours(start, 24 * 40)
    requests = spark.range(days).selectExpr(
        f"to_utc_timestamp(timestamp_ntz '{first}' + make_dt_interval(cast(id as int)), 'Europe/Paris') AS target_date"
    )
    got = w.request_windows(requests, df, S, "ts", ["value"], ["value"], "value")
    rows = got.selectExpr(
        "target_date", "status", "size(past) AS n", "unix_seconds(target_date) - unix_seconds(past[0].ts) AS back", "size(future) AS m"
    ).collect()
    short = {r.target_date for r in rows if r.status != "ok"}
    assert len(rows) == days and all((r.n, r.back) == (168, 168 * 3600) for r in rows)
    # The horizon is cut off at local midnight, so only the 23-hour day is short.
    assert short == ({datetime(2024, 3, 30, 23)} if first.month == 3 else set())
    made = w.make_windows(df, S, "ts", ["value"], ["value"], "value")
    made = made.selectExpr("anchor AS target_date", "transform(past, r -> r.value) AS want")
    both = got.selectExpr("target_date", "transform(past, r -> r.value) AS had").join(made, "target_date")
    assert both.count() == days and both.where("had <> want").count() == 0


def test_ranks_match_a_plain_window(spark, hours):
    df = hours("2024-01-01", 2500, skip=set(range(100, 900))).unionByName(hours("2024-02-01", 77, series="B"))
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("series").orderBy("ts")))
    got = ordered.rank_in_series(want, S, "ts")
    assert got.where("_rank <> want").count() == 0 and got.count() == 1777
    assert {r[0] for r in got.where("series = 'B'").select("_n").distinct().collect()} == {77}


def test_running_total_matches_a_plain_window(spark, hours):
    df = hours("2024-01-01", 2500)
    over = Window.partitionBy("series").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    both = ordered.running_total(df, S, "ts", F.col("value"), "got").withColumn("want", F.sum("value").over(over))
    assert both.where("got <> want").count() == 0


@pytest.mark.parametrize("width, gap", [(3600, 3600), (7200, 3600), (5 * 3600, 3600), (86400, 7200), (28 * 86400, 3600)])
def test_segments_by_definition_whatever_the_buckets(spark, width, gap):
    """Runs inside a bucket, over one edge, over many buckets, single rows, and several in a bucket."""
    import random
    from datetime import datetime, timedelta

    rng = random.Random(width + gap)
    rows, want, first = [], [], datetime(2024, 1, 1)
    for series in "ABCDE":
        at, stamps = first, []
        for _ in range(rng.randint(0, 30)):
            for _ in range(rng.choice([1, 1, 2, 5, 40])):
                stamps.append(at)
                at += timedelta(seconds=rng.choice([600, 1800, 3600]))
            at += timedelta(seconds=rng.choice([3601, 7200, 7201, 20000, 400000]))
        rows += [(series, t) for t in stamps]
        run = []
        for t in stamps:
            if run and (t - run[-1][1]).total_seconds() <= gap:
                run[-1] = (run[-1][0], t, run[-1][2] + 1)
            else:
                run.append((t, t, 1))
        want += [(series, k, *r) for k, r in enumerate(run)]
    df = spark.createDataFrame(rows + [("A", None)], "series STRING, ts TIMESTAMP").repartition(4)
    got = w.segments(df, ["series"], "ts", gap, width)
    assert sorted(map(tuple, got.collect())) == sorted(want)
