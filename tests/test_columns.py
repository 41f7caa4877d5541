import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tsforge.constants import ENTITY_CODES, FORECAST_RENAMES
from tsforge.functions import columns as c


def test_local_time_follows_clock_change(spark):
    df = spark.sql("SELECT timestamp'2024-03-31 00:30:00' AS ts UNION ALL SELECT timestamp'2024-03-31 01:30:00'")
    got = sorted(r.local_ts for r in c.localise(df).collect())
    assert got == [datetime(2024, 3, 31, 1, 30), datetime(2024, 3, 31, 3, 30)]


def test_strict_codes_stop_on_unknown(spark):
    df = spark.createDataFrame([("France",), ("Atlantis",)], "country STRING")
    loose = {r.country: r.code for r in c.map_codes(df, "country", ENTITY_CODES, "code").collect()}
    assert loose == {"France": "FR", "Atlantis": None}
    with pytest.raises(Exception, match="no code for country"):
        c.map_codes(df, "country", ENTITY_CODES, "code", strict=True).collect()


def test_threshold_boundaries_null_and_nan(spark):
    df = spark.createDataFrame([(1000.0,), (999.9,), (None,), (float("nan"),)], "p_price DOUBLE")
    assert [r.p_price for r in c.threshold_filter(df, ["p_price"]).collect()] == [999.9]


def test_rename_substring_is_ordered(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`FR_forecast_load` INT, `FR_Wind Onshore` INT, FR_Solar INT")
    assert c.rename_substring(df, FORECAST_RENAMES).columns == [
        "FR_Load_forecast", "FR_Wind_Onshore_forecast", "FR_Solar_forecast",
    ]


def test_cyclical_year_uses_local_leap_year(spark):
    # 23:30 UTC on New Year's Eve is already next year in Paris.
    df = spark.createDataFrame([(datetime(2023, 12, 31, 22, 30),), (datetime(2023, 12, 31, 23, 30),)], "ts TIMESTAMP")
    rows = c.cyclical_year(df).withColumn("s", F.unix_seconds("ts")).orderBy("ts").collect()
    for row, days in zip(rows, (365, 366)):
        assert row.Year_sin == pytest.approx(math.sin(2 * math.pi * row.s / (days * 86400)), abs=1e-12)


def test_signed_log_round_trip_over_price_range(spark):
    df = spark.range(-500, 3001, 7).select(F.col("id").cast("double").alias("x"))
    bad = df.where(F.abs(c.signed_exp(c.signed_log("x")) - F.col("x")) > 1e-9)
    assert bad.count() == 0


def test_parse_dmy_rejects_bad_text(spark):
    df = spark.createDataFrame([("31/03/2024",), ("2024-03-31",), ("32/01/2024",)], "t STRING")
    assert [r.d for r in df.select(c.parse_dmy("t").alias("d")).collect()] == [datetime(2024, 3, 30, 23), None, None]


def test_routing_of_generation_types(spark):
    rows = [
        ("Hydro Pumped Storage", "Actual Aggregated", "Hydro Pumped Storage_Generation"),
        ("Hydro Pumped Storage", "Actual Consumption", "Hydro Pumped Storage_Consumption"),
        ("Hydro Pumped Storage", "Other", None),
        ("Solar", "Actual Consumption", None),
        ("Solar", "Actual Aggregated", "Solar"),
        ("Perpetual Motion", "Actual Aggregated", None),
        ("Nuclear [MW]", None, "Nuclear"),
    ]
    df = spark.createDataFrame(rows, "type STRING, aggregation STRING, want STRING")
    got = c.route_types(df).collect()
    assert len(got) == 4 and all(r.generation_type == r.want for r in got)


def test_year_filter_reaches_the_scan(spark):
    from tsforge.plans import views as v

    orders = v.table(spark, "/root/testdata/sf0.001", "orders").select("o_orderkey", "o_orderdate")
    plan = c.filter_years(orders, "o_orderdate", [1996, 1997])._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(o_orderdate,1995-12-31 23:00:00.0)" in pushed
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp>" in plan


def test_empty_range_can_be_an_error(spark, hours):
    with pytest.raises(ValueError):
        c.filter_range(hours("2024-01-01", 5), "ts", "2030-01-01", "2030-01-02", require_rows=True)
