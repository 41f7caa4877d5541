"""Series with bursts: even buckets, same results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tsforge.functions import ordered as o
from tsforge.operators import windows as w

DEPTH = o.EquiDepth(rows=500)


@pytest.fixture(scope="module")
def burst(spark):
    """Half a year of hours, and an hour with 20,000 rows in it; another series without; one stamp often."""
    first = datetime(2024, 1, 1)
    rows = [("A", first + timedelta(hours=i), i) for i in range(24 * 180)]
    rows += [("A", first + timedelta(days=40, microseconds=180_000 * i + 1), 100_000 + i) for i in range(20_000)]
    rows += [("B", first + timedelta(hours=5 * i), 200_000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "series STRING, ts TIMESTAMP, id INT")
    return df.withColumn("value", F.when(F.col("id") % 7 == 0, F.col("id").cast("double"))).repartition(6).cache()


def test_buckets_are_even_and_in_order(burst):
    cut = o.bucketed(burst, "ts", DEPTH, ["series"])
    sizes = cut.groupBy("series", o.BUCKET).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    rows = sizes.where("series = 'A'").orderBy(o.BUCKET).collect()
    assert all(a.hi < b.lo for a, b in zip(rows, rows[1:]))
    n = sorted(r.n for r in rows)
    assert sum(n) == 24 * 180 + 20_000 and n[-1] <= 3 * n[len(n) // 2] and len(n) > 40
    plain = o.bucketed(burst, "ts").groupBy("series", o.BUCKET).count().agg(F.max("count")).first()[0]
    assert plain > 20_000


def _same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


def test_steps_give_the_same_rows(burst):
    S = ["series"]
    for step in (
        lambda width: o.fill_gaps(burst, S, "ts", ["value"], backward=True, width=width),
        lambda width: o.previous_row(burst, S, "ts", ["id"], width=width),
        lambda width: o.running_total(burst, S, "ts", F.col("id"), "total", width=width),
        lambda width: o.rank_in_series(burst, S, "ts", ["id"], width=width),
        lambda width: w.segments(burst, S, "ts", 3600, width),
    ):
        _same(step(o.BUCKET_SECONDS), step(DEPTH))


def test_one_stamp_stays_together(spark):
    df = spark.range(3000).select(F.lit("A").alias("series"), F.timestamp_seconds(F.lit(10_000) + F.col("id") % 2).alias("ts"), "id")
    ranked = o.rank_in_series(df, ["series"], "ts", ["id"], width=o.EquiDepth(rows=100))
    assert sorted(r._rank for r in ranked.collect()) == list(range(1, 3001))
