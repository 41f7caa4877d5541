"""Load control and quality reports."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.constants import FLOW_HUB, FLOW_NEIGHBOURS
from tsforge.operators import quality as q
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import local, r6
from tsforge.session import scratch_path
from tsforge.sources import tableset


def _order_years(spark, folder):
    """Years with orders, per priority: the range a load run must cover."""
    orders = v.table(spark, folder, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("country")).agg(
        F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year")
    )


_CHUNKS = """chunks AS (SELECT country, s AS lo, least(s + INTERVAL 90 DAY, stop) AS hi FROM (
      SELECT country, stop, unnest(generate_series(make_timestamp(a, 1, 1, 0, 0, 0), stop - INTERVAL 1 SECOND, INTERVAL 90 DAY)) AS s
      FROM (SELECT o_orderpriority AS country, min(year(o_orderdate)) AS a, make_timestamp(max(year(o_orderdate)) + 1, 1, 1, 0, 0, 0) AS stop
            FROM orders GROUP BY 1)))"""
_UTC = "timezone('UTC', timezone('Europe/Paris', {}))"


@query(
    "chunk_calendar",
    f"WITH {_CHUNKS} SELECT country, {_UTC.format('lo')} AS start_date, {_UTC.format('hi')} AS end_date FROM chunks",
)
def chunk_calendar(spark, folder):
    return q.chunks_of_years(_order_years(spark, folder), "first_year", "last_year").select(
        "country", "start_date", "end_date"
    )


@query(
    "pending_chunks",
    """SELECT e.country, t.data_type, e.start_date, e.end_date FROM
      (SELECT DISTINCT country, start_date, end_date FROM {chunk_log}) e,
      (SELECT unnest(['F', 'O', 'P', 'X']) AS data_type) t
      WHERE NOT EXISTS (SELECT 1 FROM {chunk_log} l WHERE l.status = 'success' AND l.country = e.country
        AND l.data_type = t.data_type AND l.start_date = e.start_date AND l.end_date = e.end_date)""",
)
def pending_chunks(spark, folder):
    log = v.chunk_log(spark, folder)
    covered = log.select("country", "start_date", "end_date").distinct()
    return q.pending(q.expected_chunks(covered, ["F", "O", "P", "X"]), log).select(*q.CHUNK_KEYS)


_AS_COUNTRY = {"1-URGENT": "France", "2-HIGH": "Germany", "3-MEDIUM": "Spain", "4-NOT SPECIFIED": "Italy", "5-LOW": "Norway"}
_SHIFT = 20  # years: moves the order dates across the change of the German zone


def _dated_entities(spark, folder):
    names = F.create_map(*[F.lit(x) for kv in _AS_COUNTRY.items() for x in kv])
    orders = v.table(spark, folder, "orders")
    return orders.select(
        "o_orderkey",
        names[F.col("o_orderpriority")].alias("country"),
        (F.col("o_orderdate") + F.expr(f"INTERVAL {_SHIFT} YEARS")).alias("ts"),
    )


_COUNTRY_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in _AS_COUNTRY.items()) + " END"


@query(
    "zone_effective",
    f"""SELECT o_orderkey, country, ts, CASE country WHEN 'France' THEN '10YFR-RTE------C' WHEN 'Spain' THEN '10YES-REE------0'
      WHEN 'Italy' THEN '10Y1001A1001A73I' WHEN 'Germany' THEN
        CASE WHEN ts < {_UTC.format("TIMESTAMP '2018-10-01'")} THEN '10Y1001A1001A63L' ELSE '10Y1001A1001A82H' END END AS zone_code
    FROM (SELECT o_orderkey, {_COUNTRY_CASE} AS country, o_orderdate + INTERVAL {_SHIFT} YEAR AS ts FROM orders)""",
)
def zone_effective(spark, folder):
    return q.zone_at(_dated_entities(spark, folder), q.zone_table(spark))


@query(
    "transition_chunks",
    f"""WITH d AS (SELECT {_COUNTRY_CASE} AS country, o_orderdate + INTERVAL {_SHIFT} YEAR AS ts FROM orders),
    c AS (SELECT country, date_trunc('year', ts)::TIMESTAMP AS start_date,
      (date_trunc('year', ts) + INTERVAL 1 YEAR)::TIMESTAMP AS end_date, count(*) AS orders FROM d GROUP BY 1, 2, 3)
    SELECT * FROM c WHERE country = 'Germany' AND start_date < {_UTC.format("TIMESTAMP '2018-10-01'")}
      AND end_date >= {_UTC.format("TIMESTAMP '2018-10-01'")}""",
)
def transition_chunks(spark, folder):
    start = F.date_trunc("year", "ts")
    chunks = (
        _dated_entities(spark, folder)
        .groupBy("country", start.alias("start_date"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .select("country", "start_date", (F.col("start_date") + F.expr("INTERVAL 1 YEAR")).alias("end_date"), "orders")
    )
    return q.spanning(chunks, q.zone_table(spark))


_NEIGHBOUR_ROWS = ", ".join(f"'{n}'" for n in FLOW_NEIGHBOURS)


@query(
    "flow_tasks",
    f"""SELECT c.start_date, c.end_date, CASE WHEN d.out THEN '{FLOW_HUB}' ELSE n.name END AS country_from,
      CASE WHEN d.out THEN n.name ELSE '{FLOW_HUB}' END AS country_to
    FROM (SELECT DISTINCT start_date, end_date FROM {{chunk_log}}) c, (SELECT unnest([{_NEIGHBOUR_ROWS}]) AS name) n,
      (SELECT unnest([true, false]) AS out) d""",
)
def flow_tasks(spark, folder):
    chunks = v.chunk_log(spark, folder).select("start_date", "end_date").distinct()
    return q.pair_tasks(chunks, FLOW_HUB, FLOW_NEIGHBOURS)


@query(
    "log_summary",
    """SELECT country, data_type, min(start_date) AS first_chunk, max(end_date) AS last_chunk, count(*) AS chunks
    FROM {chunk_log} WHERE status = 'success' GROUP BY 1, 2""",
)
def log_summary(spark, folder):
    return q.log_summary(v.chunk_log(spark, folder))


@query(
    "table_summary",
    """SELECT country, min("timestamp") AS first_date, max("timestamp") AS last_date, count(*) AS total_records
    FROM {prices} GROUP BY 1""",
)
def table_summary(spark, folder):
    return q.summary(v.prices(spark, folder), ["country"], "timestamp")


@query(
    "conditional_counts",
    """SELECT country, min("timestamp") AS first_date, max("timestamp") AS last_date, count(*) AS total_records,
      count(actual_load) AS actual_load_records, count(forecast_load) AS forecast_load_records FROM {load} GROUP BY 1""",
)
def conditional_counts(spark, folder):
    return q.summary(v.load(spark, folder), ["country"], "timestamp", measures=["actual_load", "forecast_load"])


@query(
    "two_key_summary",
    """SELECT country, generation_type, min("timestamp") AS first_date, max("timestamp") AS last_date,
      count(*) AS total_records FROM {generation} GROUP BY 1, 2""",
)
def two_key_summary(spark, folder):
    return q.summary(v.generation(spark, folder), ["country", "generation_type"], "timestamp")


@query(
    "entities_all",
    """SELECT country FROM {prices} UNION SELECT country FROM {load} UNION SELECT country FROM {generation}
    UNION SELECT country_from FROM {flows} UNION SELECT country_to FROM {flows}""",
)
def entities_all(spark, folder):
    tables = v.market_tables(spark, folder)
    tables.pop("wind_solar_forecast")
    return q.entities(tables)


@query(
    "pairs_touching",
    "SELECT DISTINCT country_from, country_to FROM {trade} WHERE country_from = 'NATION_3' OR country_to = 'NATION_3'",
)
def pairs_touching(spark, folder):
    return q.pairs_of(v.trade(spark, folder), "NATION_3")


@query(
    "gap_report",
    """WITH seen AS (
      SELECT event_type AS name, 'hourly' AS type, count(DISTINCT date_trunc('hour', ts)) AS n FROM events GROUP BY 1
      UNION ALL SELECT country_from || '->' || country_to, 'crossborder_flows', count(DISTINCT date_trunc('hour', "timestamp")) FROM {flows} GROUP BY 1)
    SELECT name, type, 720 - n AS missing, 720::BIGINT AS expected FROM seen WHERE n < 720""",
)
def gap_report(spark, folder):
    start, end = "2024-01-01 00:00:00", "2024-01-30 23:00:00"
    hourly = q.gap_report(v.hourly(spark, folder), ["series"], "ts", start, end, "hourly")
    flows = v.flows(spark, folder).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    pairs = q.gap_report(flows, ["country_from", "country_to"], "timestamp", start, end, "crossborder_flows")
    return hourly.unionByName(pairs)


@query(
    "delete_by_entity",
    """SELECT 'left' AS part, country_from, country_to, count(*) AS "rows" FROM {flows}
      WHERE country_from <> 'Spain' AND country_to <> 'Spain' GROUP BY 2, 3
    UNION ALL SELECT 'deleted', NULL, NULL, count(*) FROM {flows} WHERE country_from = 'Spain' OR country_to = 'Spain'
    UNION ALL SELECT 'log_deleted', NULL, NULL, count(*) FROM {chunk_log} WHERE country = 'Spain' AND data_type = 'F'""",
)
def delete_by_entity(spark, folder):
    left, _log, counts = q.delete_by_entity(
        v.flows(spark, folder), v.chunk_log(spark, folder), "Spain", "F", ["country_from", "country_to"]
    )
    kept = left.groupBy("country_from", "country_to").agg(F.count(F.lit(1)).alias("rows"))
    none = F.lit(None).cast("string")
    removed = counts.unpivot([], ["deleted", "log_deleted"], "part", "rows")
    return kept.select(F.lit("left").alias("part"), "country_from", "country_to", "rows").unionByName(
        removed.select("part", none.alias("country_from"), none.alias("country_to"), "rows")
    )


_MARKET_LOG = """SELECT (['France', 'Germany', 'Spain', 'Italy'])[o_custkey % 4 + 1] AS country,
      (['prices', 'load', 'generation', 'wind_solar_forecast', 'crossborder_flows'])[o_custkey // 4 % 5 + 1] AS data_type, o_orderdate AS start_date FROM orders"""


def _market_set(spark, folder):
    """The five market tables and a log of their chunks, as a table set of its own."""
    orders = v.table(spark, folder, "orders")

    def pick(names, number):
        return F.element_at(F.array(*map(F.lit, names)), number.cast("int"))

    log = orders.select(
        pick(["France", "Germany", "Spain", "Italy"], F.col("o_custkey") % 4 + 1).alias("country"),
        pick(list(tableset.TABLE_OF), F.floor(F.col("o_custkey") / 4) % 5 + 1).alias("data_type"),
        F.col("o_orderdate").alias("start_date"),
    )
    root = scratch_path(spark, "tables")
    views = (v.prices, v.load, v.generation, v.wind_solar, v.flows)
    tables = {name: view(spark, folder) for name, view in zip(tableset.TABLE_OF.values(), views)}
    tableset.create(spark, root, {**tables, tableset.LOG: log})
    return root


_KEPT = " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", count(*) FILTER (WHERE {hit}) AS deleted, count(*) FILTER (WHERE NOT ({hit})) AS kept FROM {view}"""
    for name, view, hit in (
        ("day_ahead_prices", "{prices}", "country = 'Spain'"),
        ("load_data", "{load}", "country = 'Spain'"),
        ("generation_data", "{generation}", "country = 'Spain'"),
        ("wind_solar_forecast", "{wind_solar}", "country = 'Spain'"),
        ("crossborder_flows", "{flows}", "country_from = 'Spain' OR country_to = 'Spain'"),
        ("download_log", f"({_MARKET_LOG})", "country = 'Spain'"),
    )
)


@query("delete_all_types", f"""SELECT "table", deleted, kept, kept AS left_rows, 0::BIGINT AS left_of_entity FROM ({_KEPT})""")
def delete_all_types(spark, folder):
    """One entity out of five tables and the log in one call; what the manifest then names is counted again."""
    root = _market_set(spark, folder)
    counts = tableset.delete(spark, root, "Spain")
    left = []
    for name in (*tableset.TABLE_OF.values(), tableset.LOG):
        ends = tableset.ENDS.get(name, ("country",))
        gone = reduce(lambda a, b: a | b, [F.col(c) == "Spain" for c in ends])
        found = tableset.read(spark, root, name).agg(
            F.count(F.lit(1)).alias("left_rows"), F.count_if(gone).alias("left_of_entity")
        )
        left.append(found.select(F.lit(name).alias("table"), "left_rows", "left_of_entity"))
    return counts.join(reduce(DataFrame.unionByName, left), "table")


@query(
    "clear_log",
    """SELECT country, data_type, start_date, end_date, download_timestamp, status FROM {chunk_log}
    WHERE NOT (status = 'success' AND country IN ('1-URGENT', '2-HIGH') AND data_type IN ('F', 'O'))""",
)
def clear_log(spark, folder):
    return q.clear_log(v.chunk_log(spark, folder), ["1-URGENT", "2-HIGH"], ["F", "O"])


# The full cleaning sequence in SQL, step by step, each on the rows the last one left.
CLEAN_SQL = """s0 AS (SELECT * FROM {market}),
    s1 AS (SELECT a.ts, a."FR_price", a."DE_price", a."FR_Load_forecast", a."FR_DE_flow",
      coalesce(a."FR_Solar_forecast", (p."FR_Solar_forecast" + n."FR_Solar_forecast") / 2) AS "FR_Solar_forecast",
      coalesce(a."FR_Wind_Onshore_forecast", (p."FR_Wind_Onshore_forecast" + n."FR_Wind_Onshore_forecast") / 2) AS "FR_Wind_Onshore_forecast",
      coalesce(a."FR_Wind_Offshore_forecast", (p."FR_Wind_Offshore_forecast" + n."FR_Wind_Offshore_forecast") / 2, 0.0) AS "FR_Wind_Offshore_forecast",
      (a."FR_Solar_forecast" IS NULL)::INT + (a."FR_Wind_Onshore_forecast" IS NULL)::INT + (a."FR_Wind_Offshore_forecast" IS NULL)::INT AS m,
      (a."FR_Solar_forecast" IS NULL AND p."FR_Solar_forecast" + n."FR_Solar_forecast" IS NOT NULL)::INT
        + (a."FR_Wind_Onshore_forecast" IS NULL AND p."FR_Wind_Onshore_forecast" + n."FR_Wind_Onshore_forecast" IS NOT NULL)::INT
        + (a."FR_Wind_Offshore_forecast" IS NULL AND p."FR_Wind_Offshore_forecast" + n."FR_Wind_Offshore_forecast" IS NOT NULL)::INT AS f
      FROM s0 a LEFT JOIN s0 p ON p.ts = a.ts - INTERVAL 1 HOUR LEFT JOIN s0 n ON n.ts = a.ts + INTERVAL 1 HOUR),
    r1 AS (SELECT * FROM s1 WHERE "FR_Solar_forecast" IS NOT NULL AND "FR_Wind_Onshore_forecast" IS NOT NULL AND "FR_Wind_Offshore_forecast" IS NOT NULL),
    s2 AS (SELECT a.* REPLACE (coalesce(a."FR_price", p."FR_price") AS "FR_price", coalesce(a."DE_price", p."DE_price") AS "DE_price",
      (a."FR_price" IS NULL)::INT + (a."DE_price" IS NULL)::INT AS m,
      (a."FR_price" IS NULL AND p."FR_price" IS NOT NULL)::INT + (a."DE_price" IS NULL AND p."DE_price" IS NOT NULL)::INT AS f)
      FROM r1 a LEFT JOIN r1 p ON p.ts = a.ts - INTERVAL 168 HOUR),
    r2 AS (SELECT * FROM s2 WHERE "FR_price" IS NOT NULL AND "DE_price" IS NOT NULL),
    s3 AS (SELECT a.* REPLACE (coalesce(a."FR_Load_forecast", p."FR_Load_forecast") AS "FR_Load_forecast",
      (a."FR_Load_forecast" IS NULL)::INT AS m, (a."FR_Load_forecast" IS NULL AND p."FR_Load_forecast" IS NOT NULL)::INT AS f)
      FROM r2 a LEFT JOIN r2 p ON p.ts = a.ts - INTERVAL 168 HOUR),
    r3 AS (SELECT * FROM s3 WHERE "FR_Load_forecast" IS NOT NULL),
    s4 AS (SELECT * REPLACE (("FR_DE_flow" IS NULL)::INT AS m, 0 AS f) FROM r3),
    r4 AS (SELECT * FROM s4 WHERE "FR_DE_flow" IS NOT NULL)"""


@query(
    "step_report",
    f"""WITH {CLEAN_SQL}, t AS (
      SELECT 1 AS number, 'renewables' AS step, sum(m) AS m, sum(f) AS f, (SELECT count(*) FROM s0) AS b, (SELECT count(*) FROM r1) AS r FROM s1
      UNION ALL SELECT 2, 'prices', sum(m), sum(f), (SELECT count(*) FROM r1), (SELECT count(*) FROM r2) FROM s2
      UNION ALL SELECT 3, 'load', sum(m), sum(f), (SELECT count(*) FROM r2), (SELECT count(*) FROM r3) FROM s3
      UNION ALL SELECT 4, 'flows', sum(m), sum(f), (SELECT count(*) FROM r3), (SELECT count(*) FROM r4) FROM s4)
    SELECT number, step, m::BIGINT AS missing, f::BIGINT AS filled, (m - f)::BIGINT AS missing_after, b - r AS rows_dropped,
      r AS rows_left, {r6('r / (SELECT count(*) FROM s0) * 100')} AS percent_kept FROM t""",
)
def step_report(spark, folder):
    return q.step_report(v.market(spark, folder)).withColumn("percent_kept", v.r6("percent_kept"))


@query(
    "null_profile",
    """WITH j AS (SELECT d.*, m."EUA_EUR", m."TTF_EUR", m."ARA_EUR" FROM {daily} d
      LEFT JOIN (SELECT * FROM {month_prices} WHERE "Month" < '2001-01' AND "Month" <> '1997-05') m ON strftime(d.ts, '%Y-%m') = m."Month")
    SELECT 'EUA_EUR' AS "column", count(*) FILTER (WHERE "EUA_EUR" IS NULL) AS nulls FROM j
    UNION ALL SELECT 'TTF_EUR', count(*) FILTER (WHERE "TTF_EUR" IS NULL) FROM j
    UNION ALL SELECT 'ARA_EUR', count(*) FILTER (WHERE "ARA_EUR" IS NULL) FROM j
    UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL) FROM j""",
)
def null_profile(spark, folder):
    """Nulls left by a monthly lookup that has one month missing and ends early."""
    from tsforge.operators.joins import month_lookup

    months = v.month_prices(spark, folder).where("Month < '2001-01' and Month <> '1997-05'")
    joined = month_lookup(v.daily(spark, folder), months, "ts", tz="UTC")
    return q.null_profile(joined, ["EUA_EUR", "TTF_EUR", "ARA_EUR", "value"])


@query(
    "year_counts",
    f"""SELECT year({local('o_orderdate')})::INTEGER AS year, count(*) AS "rows" FROM orders GROUP BY 1""",
)
def year_counts(spark, folder):
    return q.year_counts(v.table(spark, folder, "orders"), "o_orderdate")
