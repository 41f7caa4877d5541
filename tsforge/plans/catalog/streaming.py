"""The loads as streams over files, run to the end of what is there."""

from pyspark.sql import functions as F

from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import r6
from tsforge.session import pin_utc, scratch_path
from tsforge.streaming import streams


def _landing(spark, folder):
    """The events as a folder of files that a stream picks up two at a time, oldest first."""
    path = scratch_path(pin_utc(spark), "landing")
    rows = v.events(spark, folder).select("event_id", "ts", "event_type", "value")
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return streams.read_files(spark, path, rows.schema, per_batch=2)


@query(
    "stream_resample",
    f"""SELECT series, ts, {r6('value')} AS value FROM {{hourly}}
    WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""",
)
def stream_resample(spark, folder):
    """Files may come in any order, so lateness is bounded by the month they span."""
    events = spark.readStream.schema(v._DDL["events"]).option("pathGlobFilter", "events.parquet").parquet(folder)
    means = streams.stream_resample(events.withColumnRenamed("event_type", "series"), ["series"], "ts")
    out = scratch_path(pin_utc(spark), "hourly")
    streams.run_available(means, out, scratch_path(spark, "progress"))
    done = spark.read.schema("series STRING, ts TIMESTAMP, value DOUBLE").parquet(out)
    return done.withColumn("value", v.r6("value"))


@query("stream_dedupe", "SELECT DISTINCT event_type, date_trunc('hour', ts) AS hour FROM events")
def stream_dedupe(spark, folder):
    events = spark.readStream.schema(v._DDL["events"]).option("pathGlobFilter", "events.parquet").parquet(folder)
    keyed = events.select("event_type", F.date_trunc("hour", "ts").alias("hour"), "ts")
    first = streams.stream_dedupe(keyed, ["event_type", "hour"], "ts").select("event_type", "hour")
    out = scratch_path(pin_utc(spark), "first")
    streams.run_available(first, out, scratch_path(spark, "progress"))
    return spark.read.schema("event_type STRING, hour TIMESTAMP").parquet(out)


@query(
    "stream_first",
    """SELECT event_type, date_trunc('hour', ts) AS hour, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2""",
)
def stream_first(spark, folder):
    """The least event of each type and hour, from eight files that mix all days, two a batch, with a
    restart after the first half: the greatest revision of a key is its answer."""
    landing, out, progress = (scratch_path(pin_utc(spark), name) for name in ("landing", "first", "progress"))
    events = v.events(spark, folder).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(8)))
    ddl = "event_type STRING, hour TIMESTAMP, ts TIMESTAMP, event_id BIGINT, value DOUBLE"
    for half in (F.col("part") < 4, F.col("part") >= 4):
        rows = events.where(half).withColumn("hour", F.date_trunc("hour", "ts"))
        rows.repartition(4, "part").select("event_type", "hour", "ts", "event_id", "value").write.mode("append").parquet(landing)
        arriving = streams.read_files(spark, landing, ddl, per_batch=2)
        first = streams.stream_first(arriving, ["event_type", "hour"], "ts", ["event_id"], "60 days")
        streams.run_available(first, out, progress)
    found = spark.read.schema(f"{ddl}, revision INT").parquet(out)
    newest = found.groupBy("event_type", "hour").agg(*[F.max_by(c, "revision").alias(c) for c in ("event_id", "value")])
    return newest


@query(
    "stream_ingest",
    """SELECT event_type, date_trunc('hour', ts) AS hour, max(event_id) AS event_id, arg_max(value, event_id) AS value,
      strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY 1, 2, 5""",
)
def stream_ingest(spark, folder):
    """Each file is merged into a table by day: the latest event of a type and hour stays."""
    out = scratch_path(pin_utc(spark), "table")

    def keyed(batch):
        return batch.select(
            "event_type",
            F.date_trunc("hour", "ts").alias("hour"),
            "event_id",
            "value",
            F.date_format("ts", "yyyy-MM-dd").alias("day"),
        )

    streams.stream_ingest(
        _landing(spark, folder), out, scratch_path(spark, "progress"), ["event_type", "hour", "day"], ["day"], "event_id", keyed
    )
    return spark.read.schema("event_type STRING, hour TIMESTAMP, event_id BIGINT, value DOUBLE, day STRING").parquet(out)
