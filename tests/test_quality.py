from datetime import datetime

from pyspark.sql import functions as F

from tsforge.operators import quality as q


def test_chunks_are_contiguous_and_cover_the_years(spark):
    rows = q.chunk_calendar(spark, 2015, 2016).orderBy("start_date").collect()
    assert rows[0].start_date == datetime(2014, 12, 31, 23) and rows[-1].end_date == datetime(2016, 12, 31, 23)
    assert all(a.end_date == b.start_date for a, b in zip(rows, rows[1:]))
    assert len(rows) == 9


def test_pending_ignores_failed_chunks(spark):
    expected = q.expected_chunks(
        q.chunk_calendar(spark, 2015, 2015).withColumn("country", F.lit("France")), ["prices"]
    ).select(*q.CHUNK_KEYS)
    starts = [r.start_date for r in expected.orderBy("start_date").collect()]
    log = expected.withColumn(
        "status",
        F.when(F.col("start_date").isin(starts[:2]), "success").when(F.col("start_date") == F.lit(starts[2]), "error"),
    ).where("status is not null")
    left = q.pending(expected, log)
    assert sorted(r.start_date for r in left.collect()) == starts[2:]


def test_zone_change_and_spanning_chunks(spark):
    zones = q.zone_table(spark)
    days = [(datetime(2018, 9, 30, 21),), (datetime(2018, 9, 30, 22),)]
    df = spark.createDataFrame(days, "ts TIMESTAMP").withColumn("country", F.lit("Germany"))
    got = [r.zone_code for r in q.zone_at(df, zones).orderBy("ts").collect()]
    assert got == ["10Y1001A1001A63L", "10Y1001A1001A82H"]
    chunks = spark.createDataFrame(
        [("Germany", datetime(2018, 9, 1), datetime(2018, 11, 1)), ("Germany", datetime(2018, 11, 1), datetime(2018, 12, 1)),
         ("France", datetime(2018, 9, 1), datetime(2018, 11, 1))],
        "country STRING, start_date TIMESTAMP, end_date TIMESTAMP",
    )
    assert q.spanning(chunks, zones).count() == 1 and q.spanning(chunks, zones, skip=True).count() == 2


def test_flow_tasks_go_both_ways(spark):
    chunks = spark.range(2).withColumnRenamed("id", "chunk")
    got = q.pair_tasks(chunks, "France", ["Spain", "Italy"])
    assert got.count() == 8 and got.where("country_from = 'Spain' and country_to = 'France'").count() == 2


def test_gap_report_equals_the_grid_difference(spark, hours):
    df = hours("2024-01-01", 48, skip={5, 6, 30}).unionByName(hours("2024-01-01", 48, series="B"))
    span = ("2024-01-01 00:00:00", "2024-01-02 23:00:00")
    assert [tuple(r) for r in q.gap_report(df, ["series"], "ts", *span).collect()] == [("A", "value", 3, 48)]
    assert q.missing_hours(df, ["series"], "ts", *span).count() == 3


def test_clear_log_keeps_errors_and_nulls(spark):
    log = spark.createDataFrame(
        [("A", "prices", "success"), ("A", "prices", "error"), (None, "prices", "success"), ("B", "load", "success")],
        "country STRING, data_type STRING, status STRING",
    )
    assert q.clear_log(log, ["A"]).count() == 3 and q.clear_log(log).count() == 1
    assert q.clear_log(log, ["A", "B"], ["load"]).count() == 3
