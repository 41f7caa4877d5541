from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tsforge.operators import quality as q
from tsforge.sources import io, schemas


def test_conform_defaults_unit_and_nan(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "France", float("nan"))], "timestamp TIMESTAMP, country STRING, price DOUBLE")
    row = schemas.conform(df, "day_ahead_prices").first()
    assert (row.price, row.unit) == (None, "EUR/MWh")
    with pytest.raises(ValueError, match="missing"):
        schemas.conform(df.drop("price"), "day_ahead_prices")
    with pytest.raises(ValueError, match="unknown table"):
        schemas.schema("nope")


def test_csv_missing_column_and_bad_value(spark, tmp_path):
    path = str(tmp_path / "c")
    io.write_csv(spark.createDataFrame([("a", "1.5")], "Date STRING, Price STRING"), path)
    assert io.scan_csv(spark, path, schemas.schema("commodity")).collect() == [("a", 1.5)]
    with pytest.raises(ValueError, match="missing columns"):
        io.scan_csv(spark, path, "Date STRING, Volume DOUBLE")
    bad = str(tmp_path / "bad")
    io.write_csv(spark.createDataFrame([("a", "x")], "Date STRING, Price STRING"), bad)
    with pytest.raises(Exception):
        io.scan_csv(spark, bad, schemas.schema("commodity")).collect()


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k INT, part STRING, v DOUBLE, seq INT")


def test_upsert_is_idempotent(spark):
    target, batch = _frame(spark, [(1, "a", 1.0, 1), (2, "a", 2.0, 1)]), _frame(spark, [(2, "a", 9.0, 2), (2, "a", 8.0, 1), (3, "b", 3.0, 1)])
    once = io.upsert(target, batch, ["k"], "seq")
    twice = io.upsert(once, batch, ["k"], "seq")
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a", 1.0, 1), (2, "a", 9.0, 2), (3, "b", 3.0, 1)]


def test_upsert_table_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    io.upsert_table(spark, path, _frame(spark, [(1, "a", 1.0, 1), (2, "b", 2.0, 1)]), ["k"], ["part"], "seq")
    before = sorted(p.name for p in (tmp_path / "t" / "part=a").glob("*.parquet"))
    io.upsert_table(spark, path, _frame(spark, [(2, "b", 5.0, 2), (4, "b", 4.0, 1)]), ["k"], ["part"], "seq")
    assert sorted(p.name for p in (tmp_path / "t" / "part=a").glob("*.parquet")) == before
    got = spark.read.parquet(path).select("k", "part", "v").collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", 1.0), (2, "b", 5.0), (4, "b", 4.0)]


def test_export_counts_without_second_pass(spark, tmp_path):
    got = io.export_tables({"x": spark.range(7), "y": spark.range(3).select("id", F.lit(1).alias("z"))}, str(tmp_path / "o"))
    assert sorted(got.collect()) == [("x", 7, 1), ("y", 3, 2)]


def test_rewrite_without_reports_deletions(spark, tmp_path):
    df = spark.createDataFrame([("France", 1), ("Spain", 2), ("Spain", 3), (None, 4)], "country STRING, v INT")
    assert q.rewrite_without(df, str(tmp_path / "left"), "Spain") == 2
    assert spark.read.parquet(str(tmp_path / "left")).count() == 2


def test_window_sink_partitions_by_split_and_fold(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", 1), (2, "val", 1)], "x INT, split STRING, fold INT")
    io.write_windows(df, str(tmp_path / "w"))
    assert (tmp_path / "w" / "split=val" / "fold=1").is_dir()
