"""Scans and sinks."""

from pyspark.sql import functions as F

from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import r6
from tsforge.operators import splits
from tsforge.operators.features import feature_roles
from tsforge.session import scratch_path
from tsforge.sources import io, schemas


@query(
    "typed_tables",
    f"""SELECT 'day_ahead_prices' AS "table", country AS entity, "timestamp", {r6('price')} AS value, unit FROM {{prices}}
    UNION ALL SELECT 'load_data', country, "timestamp", {r6('forecast_load')}, unit FROM {{load}}
    UNION ALL SELECT 'generation_data', country, "timestamp", {r6('value')}, unit FROM {{generation}}
    UNION ALL SELECT 'wind_solar_forecast', country, "timestamp", {r6('value')}, unit FROM {{wind_solar}}
    UNION ALL SELECT 'crossborder_flows', country_from, "timestamp", {r6('flow')}, unit FROM {{flows}}""",
)
def typed_tables(spark, folder):
    measure = {"day_ahead_prices": "price", "load_data": "forecast_load", "crossborder_flows": "flow"}
    parts = []
    for name, df in v.market_tables(spark, folder).items():
        typed = schemas.conform(df.drop("unit"), name)
        entity = "country_from" if name == "crossborder_flows" else "country"
        parts.append(
            typed.select(
                F.lit(name).alias("table"),
                F.col(entity).alias("entity"),
                "timestamp",
                v.r6(measure.get(name, "value")).alias("value"),
                "unit",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("table_scan", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def table_scan(spark, folder):
    return v.events(spark, folder)


@query(
    "filtered_scan",
    """SELECT "timestamp", country_from, country_to, flow, unit FROM {flows}
    WHERE country_from = 'France' AND country_to = 'Spain'
    AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-20 12:00:00'""",
)
def filtered_scan(spark, folder):
    return io.scan_flows(v.flows(spark, folder), "France", "Spain", "2024-01-05 00:00:00", "2024-01-20 12:00:00")


_CSV = "day STRING, series STRING, value DOUBLE, extra STRING"


def _daily_text(spark, folder):
    return v.daily(spark, folder).select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "series", F.round("value", 2).alias("value"), F.lit("x").alias("extra")
    )


@query(
    "csv_scan",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, series, round(value, 2) AS value FROM {daily}""",
)
def csv_scan(spark, folder):
    path = scratch_path(spark, "csv_scan")
    io.write_csv(_daily_text(spark, folder), path)
    return io.scan_csv(spark, path, _CSV, ["day", "series", "value"])


@query(
    "csv_sink",
    """SELECT series, count(*) AS "rows", sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM {daily} GROUP BY 1""",
)
def csv_sink(spark, folder):
    path = scratch_path(spark, "csv_sink")
    io.write_csv(_daily_text(spark, folder), path)
    back = io.scan_csv(spark, path, _CSV)
    return back.groupBy("series").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query(
    "export_parquet_stats",
    """SELECT 'day_ahead_prices' AS "table", count(*) AS "rows", 4 AS cols FROM {prices}
    UNION ALL SELECT 'load_data', count(*), 5 FROM {load}
    UNION ALL SELECT 'generation_data', count(*), 5 FROM {generation}
    UNION ALL SELECT 'wind_solar_forecast', count(*), 5 FROM {wind_solar}
    UNION ALL SELECT 'crossborder_flows', count(*), 5 FROM {flows}""",
)
def export_parquet_stats(spark, folder):
    return io.export_tables(v.market_tables(spark, folder), scratch_path(spark, "export"))


@query("preview", "SELECT event_id, ts, event_type, value FROM events ORDER BY ts, event_id LIMIT 10")
def preview(spark, folder):
    return io.head(v.events(spark, folder).select("event_id", "ts", "event_type", "value"), ["ts", "event_id"], 10)


@query(
    "keyed_append",
    f"""WITH late AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, max(value) AS value FROM events
      WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2)
    SELECT coalesce(l.series, h.series) AS series, coalesce(l.ts, h.ts) AS ts, {r6('coalesce(l.value, h.value)')} AS value
    FROM {{hourly}} h FULL JOIN late l ON h.series = l.series AND h.ts = l.ts""",
)
def keyed_append(spark, folder):
    """Hourly means are the table; a later load brings hourly maxima for half the month."""
    late = v.resample(
        v.events(spark, folder).where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp")).withColumnRenamed("event_type", "series"),
        ["series"],
        "ts",
        "hour",
        {"value": F.max("value")},
    )
    merged = io.upsert(v.hourly(spark, folder), late, ["series", "ts"])
    return merged.withColumn("value", v.r6("value"))


@query(
    "feature_manifest",
    """WITH m AS (SELECT * FROM {market}), k AS (
      SELECT unnest(['FR_price', 'DE_price', 'FR_Load_forecast', 'FR_Solar_forecast', 'FR_Wind_Onshore_forecast', 'FR_Wind_Offshore_forecast', 'FR_DE_flow']) AS "column",
        unnest([count("FR_price"), count("DE_price"), count("FR_Load_forecast"), count("FR_Solar_forecast"),
          count("FR_Wind_Onshore_forecast"), count("FR_Wind_Offshore_forecast"), count("FR_DE_flow")]) AS known,
        unnest(range(7)) AS i FROM m)
    SELECT 'past' AS role, i::INTEGER AS position, "column", known FROM k
    UNION ALL SELECT 'future', (i - 2)::INTEGER, "column", known FROM k WHERE i BETWEEN 2 AND 5
    UNION ALL SELECT 'target', 0, "column", known FROM k WHERE i = 0""",
)
def feature_manifest(spark, folder):
    """The manifest goes to JSON and back; its columns are then profiled."""
    rows = v.market(spark, folder)
    past, future, target = feature_roles(rows, "FR_price")
    path = scratch_path(spark, "manifest")
    io.write_manifest(io.manifest(rows, target, past, future), path)
    saved = io.read_manifest(spark, path)
    return io.roles_from(rows, saved["target_col"], saved["past_cols"], saved["future_cols"])


@query(
    "window_sink",
    f"""WITH s AS (SELECT series, anchor, 'past' AS part, ts, value FROM {{past_hours}}
      UNION ALL SELECT series, anchor, 'future', anchor + INTERVAL (hour) HOUR, y FROM {{scored}})
    SELECT 'train' AS split, series, anchor, part, ts, {r6('value')} AS value FROM s""",
)
def window_sink(spark, folder):
    """Every hour of every window, read back from the sink."""
    path = scratch_path(spark, "windows")
    io.write_windows(splits.full_set(v.windows(spark, folder)), path)
    back = spark.read.parquet(path)
    key = ("split", "series", "anchor")
    past = back.select(*key, F.lit("past").alias("part"), F.inline(F.transform("past", lambda h: F.struct(h["ts"], h["value"]))))
    hours = F.zip_with("future", "y", lambda h, y: F.struct(h["ts"].alias("ts"), y.alias("value")))
    future = back.select(*key, F.lit("future").alias("part"), F.inline(hours))
    return past.toDF(*future.columns).unionByName(future).withColumn("value", v.r6("value"))
