from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tsforge.operators import clean as k
from tsforge.operators import quality as q

S, TS = ["series"], "ts"


def _values(df):
    return [r.value for r in df.orderBy("ts").collect()]


def test_prior_week_fills_only_from_originals(spark, hours):
    # Week 0 known at hour 0, null at hour 1; week 1 null at both; week 2 null at hour 0.
    gone = {1, 168, 169, 336}
    df = hours("2024-01-01", 400, lambda i: None if i in gone else float(i))
    got = _values(k.fill_prior_week(df, S, TS, ["value"], flag="filled"))
    assert got[168] == 0.0 and got[1] is None and got[169] is None and got[336] is None
    assert k.fill_prior_week(df, S, TS, ["value"], flag="filled").agg(F.sum("filled")).first()[0] == 1


def test_interpolation_needs_both_neighbours_an_hour_away(spark, hours):
    df = hours("2024-01-01", 12, lambda i: None if i in {0, 3, 6, 7, 10, 11} else float(i), skip={9})
    got = {r.ts.hour: r.value for r in k.neighbour_interpolate(df, S, TS, ["value"]).collect()}
    assert got[3] == 3.0
    assert all(got[h] is None for h in (0, 6, 7, 10, 11))


def test_bucketed_fill_equals_plain_window(spark, hours):
    """Fills cross bucket edges: compare with an unbucketed window on a small frame."""
    df = hours("2024-01-01", 3000, lambda i: float(i) if i % 1001 == 5 else None)
    w = Window.partitionBy("series").orderBy("ts")
    want = df.withColumn(
        "value",
        F.coalesce(
            F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            F.first("value", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        ),
    )
    assert _values(k.ffill_bfill(df, S, TS, ["value"])) == _values(want)
    assert _values(k.ffill(df, S, TS, ["value"]))[:7] == [None] * 5 + [5.0] * 2


def test_dedupe_keeps_the_least_and_collapses_copies(spark, hours):
    df = hours("2024-01-01", 3).unionByName(hours("2024-01-01", 3, lambda i: i - 1.0)).unionByName(hours("2024-01-01", 3))
    assert _values(k.dedupe_first(df, ["series", "ts"])) == [-1.0, 0.0, 1.0]
    assert k.mean_duplicates(df, S, TS, ["value"]).count() == 3


def test_hot_months_are_dropped(spark):
    means = [100.0, 400.0, 400.0, 400.0, 100.0, 100.0]
    rows = [(datetime(2021, m + 1, 10) + timedelta(hours=h), means[m]) for m in range(6) for h in range(3)]
    df = spark.createDataFrame(rows, "ts TIMESTAMP, FR_price DOUBLE")
    stats = {r.month: r.rolling_mean for r in k.monthly_stats(df, TS, "FR_price").collect()}
    assert stats["2021-02"] is None and stats["2021-03"] == 300.0 and stats["2021-04"] == 400.0
    left = {r.ts.month for r in k.drop_high_months(df, TS, "FR_price").collect()}
    assert left == {1, 2, 3, 5, 6}  # only April is above 300; March and May are at it
    spiky = df.unionByName(spark.createDataFrame([(datetime(2021, 1, 1), 1000.0), (datetime(2021, 1, 1), None)], df.schema))
    assert k.drop_high_months(spiky, TS, "FR_price").count() == k.drop_high_months(df, TS, "FR_price").count()


def _market(spark, n=24 * 30):
    first = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        rows.append(
            (
                first + timedelta(hours=i),
                None if i in {3, 400} else float(i),
                None if i in {10, 600} else 1.0,
                None if i in {50, 51, 300} else float(i),
                None if i % 2 else 2.0,
                None if i == 500 else 3.0,
            )
        )
    return spark.createDataFrame(
        rows,
        "ts TIMESTAMP, FR_price DOUBLE, FR_Load_forecast DOUBLE, FR_Solar_forecast DOUBLE, FR_Wind_Offshore_forecast DOUBLE, FR_DE_flow DOUBLE",
    )


def test_clean_full_on_a_known_table(spark):
    df = _market(spark)
    cleaned = k.clean_full(df)
    hours_left = {int((r.ts - datetime(2024, 1, 1)).total_seconds() // 3600) for r in cleaned.collect()}
    # 50, 51: a pair of nulls; 3 and 10: no week before; 500: flow is dropped only.
    assert set(range(720)) - hours_left == {50, 51, 3, 10, 500}
    by_hour = {int((r.ts - datetime(2024, 1, 1)).total_seconds() // 3600): r for r in cleaned.collect()}
    assert by_hour[300].FR_Solar_forecast == 300.0 and by_hour[400].FR_price == 232.0 and by_hour[600].FR_Load_forecast == 1.0
    report = {r.step: r for r in q.step_report(df).collect()}
    assert report["prices"].missing == 2 and report["prices"].filled == 1 and report["prices"].rows_dropped == 1
    assert report["flows"].rows_left == 715 and report["flows"].percent_kept == pytest.approx(715 / 720 * 100)


def test_a_dropped_row_lends_no_value(spark):
    """Hour 51 is dropped for its solar value; hour 51 + 168 must not be filled from it."""
    df = _market(spark).withColumn("FR_price", F.when(F.col("ts") != datetime(2024, 1, 10, 3), F.col("FR_price")))
    gone = 51 + 168
    assert datetime(2024, 1, 1) + timedelta(hours=gone) == datetime(2024, 1, 10, 3)
    assert k.clean_full(df).where(F.col("ts") == datetime(2024, 1, 10, 3)).count() == 0


def test_entity_family_drop(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (None, None, 2.0), (1.0, 1.0, None)], "A_x DOUBLE, A_y DOUBLE, B_x DOUBLE")
    assert k.drop_entity_all_null(df, {"A": ["A_x", "A_y"], "B": ["B_x"]}).count() == 1
