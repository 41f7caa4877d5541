from datetime import datetime, timedelta

import pytest

from tsforge.operators.reshape import resample
from tsforge.streaming import streams as s

SCHEMA = "event_id BIGINT, series STRING, ts TIMESTAMP, value DOUBLE"


def _drop(spark, folder, rows):
    """One more file in the folder, later than the ones before."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _rows(start, n, base=0):
    first = datetime(2024, 1, 1) + timedelta(minutes=start)
    return [(base + i, "AB"[i % 2], first + timedelta(minutes=15 * i), float(i)) for i in range(n)]


@pytest.fixture()
def folders(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")


def test_resample_in_pieces_equals_the_whole(spark, folders):
    landing, out, progress = folders
    pieces = [_rows(0, 40), list(reversed(_rows(600, 40, 40))), _rows(1200, 40, 80)]
    for piece in pieces:
        _drop(spark, landing, piece)
        means = s.stream_resample(s.read_files(spark, landing, SCHEMA), ["series"], "ts")
        s.run_available(means, out, progress)
    # Everything is late now: an hour closed long ago is not opened again.
    _drop(spark, landing, [(999, "A", datetime(2024, 1, 1, 0, 1), 1e6)])
    s.run_available(s.stream_resample(s.read_files(spark, landing, SCHEMA), ["series"], "ts"), out, progress)
    whole = spark.createDataFrame([r for p in pieces for r in p], SCHEMA)
    newest = max(r[2] for p in pieces for r in p)
    want = {tuple(r) for r in resample(whole, ["series"], "ts").collect() if r.ts + timedelta(hours=1) <= newest - timedelta(hours=2)}
    got = [tuple(r) for r in spark.read.parquet(out).select("series", "ts", "value").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_dedupe_over_files(spark, folders):
    landing, out, progress = folders
    for _ in range(2):
        _drop(spark, landing, _rows(0, 8))
        first = s.stream_dedupe(s.read_files(spark, landing, SCHEMA), ["event_id"], "ts", "1 day")
        s.run_available(first, out, progress)
    assert spark.read.parquet(out).count() == 8


def test_ingest_reads_each_file_once_and_is_idempotent(spark, folders, tmp_path):
    from pyspark.sql import functions as F

    landing, out, progress = folders

    def load(checkpoint):
        s.stream_ingest(
            s.read_files(spark, landing, SCHEMA), out, checkpoint, ["series", "ts", "day"], ["day"], "event_id",
            lambda b: b.withColumn("day", F.date_format("ts", "yyyy-MM-dd")),
        )
        return sorted(tuple(r) for r in spark.read.parquet(out).select("event_id", "series", "ts", "value").collect())

    _drop(spark, landing, _rows(0, 10))
    first = load(progress)
    assert load(progress) == first and len(first) == 10
    _drop(spark, landing, _rows(0, 3, base=100))
    second = load(progress)
    assert len(second) == 10 and {r[0] for r in second} == {100, 101, 102, 3, 4, 5, 6, 7, 8, 9}
    assert load(str(tmp_path / "fresh")) == second


def test_first_over_files_out_of_order_late_and_restarted(spark, folders):
    """Revisions correct a key; a row behind the watermark changes nothing; a restart forgets nothing."""
    from datetime import datetime, timedelta

    landing, out, progress = folders
    start = datetime(2024, 1, 1)
    at = lambda h: start + timedelta(hours=h)
    batches = [
        [(5, "A", at(1), 5.0), (9, "B", at(2), 9.0), (6, "A", at(1.5), 6.0)],
        [(3, "A", at(1.2), 3.0), (12, "B", at(2), 12.0), (20, "C", at(3), 20.0)],
        [(30, "D", at(48), 30.0)],  # moves the watermark far ahead
        [(1, "A", at(1), 1.0), (31, "D", at(47.5), 31.0), (29, "D", at(47), 29.0)],  # A is late now
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA_OF_FIRST).repartition(2).write.mode("append").parquet(landing)
        first = s.stream_first(s.read_files(spark, landing, SCHEMA_OF_FIRST), ["series"], "ts", ["event_id"], "2 hours")
        s.run_available(first, out, progress)
    got = sorted((r.series, r.revision, r.event_id, r.value) for r in spark.read.parquet(out).collect())
    assert got == [("A", 0, 5, 5.0), ("A", 1, 3, 3.0), ("B", 0, 9, 9.0), ("C", 0, 20, 20.0), ("D", 0, 30, 30.0), ("D", 1, 29, 29.0)]


SCHEMA_OF_FIRST = "event_id BIGINT, series STRING, ts TIMESTAMP, value DOUBLE"
