"""Projections, filters, renames and scalar functions."""

import math

from pyspark.sql import functions as F

from tsforge.constants import CANONICAL_ENTITIES, DEFAULT_FUEL, ENTITY_CODES, FORECAST_RENAMES
from tsforge.functions import columns as c
from tsforge.operators.reshape import pivot_type_mean
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import local, local_midnight, r6

_UTC = "timezone('UTC', timezone('Europe/Paris', {}))"


@query("to_local_time", f"SELECT event_id, ts, {local('ts')} AS local_ts FROM events")
def to_local_time(spark, folder):
    return c.localise(v.events(spark, folder).select("event_id", "ts"))


@query("localise_naive", f"SELECT o_orderkey, {_UTC.format('o_orderdate')} AS o_orderdate FROM orders")
def localise_naive(spark, folder):
    return c.attach_zone(v.table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query(
    "canonical_names",
    f"""SELECT CASE country WHEN 'Germany_Luxembourg' THEN 'Germany' WHEN 'Italy_North' THEN 'Italy' ELSE country END AS country,
      count(*) AS readings, {r6('avg(price)')} AS price FROM {{prices}} GROUP BY 1""",
)
def canonical_names(spark, folder):
    named = c.canonical_names(v.prices(spark, folder), CANONICAL_ENTITIES, ["country"])
    return named.groupBy("country").agg(F.count(F.lit(1)).alias("readings"), v.r6(F.avg("price")).alias("price"))


@query(
    "map_codes",
    """SELECT "timestamp", country_from, country_to, flow, a.code AS from_code, b.code AS to_code
    FROM {flows} f LEFT JOIN {codes} a ON f.country_from = a.name LEFT JOIN {codes} b ON f.country_to = b.name""",
)
def map_codes(spark, folder):
    rows = v.flows(spark, folder).drop("unit")
    rows = c.map_codes(rows, "country_from", ENTITY_CODES, "from_code")
    return c.map_codes(rows, "country_to", ENTITY_CODES, "to_code")


@query(
    "rename_units",
    f"""SELECT "timestamp", country, {r6('forecast_load')} AS forecast_load, unit AS unit_load FROM {{load}}""",
)
def rename_units(spark, folder):
    renamed = c.rename_units(v.load(spark, folder), {"unit": "unit_load"}, ["actual_load"])
    return renamed.withColumn("forecast_load", v.r6("forecast_load"))


_SOLAR = "avg(value) FILTER (WHERE forecast_type = '{}')"


@query(
    "rename_substring",
    f"""SELECT "timestamp", country, {r6(_SOLAR.format('Solar'))} AS "Solar_forecast",
      {r6(_SOLAR.format('Wind Onshore'))} AS "Wind_Onshore_forecast",
      {r6(_SOLAR.format('Wind Offshore'))} AS "Wind_Offshore_forecast"
    FROM (SELECT date_trunc('hour', "timestamp") AS "timestamp", country, forecast_type, value FROM {{wind_solar}}) GROUP BY 1, 2""",
)
def rename_substring(spark, folder):
    hourly = v.wind_solar(spark, folder).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    wide = pivot_type_mean(hourly, ["timestamp", "country"], "forecast_type", v.FORECASTS)
    named = c.rename_substring(wide, FORECAST_RENAMES)
    return named.select("timestamp", "country", *[v.r6(x).alias(x) for x in named.columns[2:]])


@query(
    "clean_type_label",
    """SELECT p_partkey, trim(split_part(p_name || ' [' || p_type || ']', ' [', 1)) AS label FROM part""",
)
def clean_type_label(spark, folder):
    parts = spark.read.schema("p_partkey BIGINT, p_name STRING, p_type STRING").parquet(f"{folder}/part.parquet")
    labelled = parts.withColumn("raw", F.concat("p_name", F.lit(" ["), "p_type", F.lit("]")))
    return labelled.select("p_partkey", c.clean_type_label("raw").alias("label"))


_KINDS = ["Hydro Pumped Storage", "Solar", "Nuclear", "Tidal Test Rig", "Wind Onshore [MW]"]
_AGGS = ["Actual Aggregated", "Actual Consumption", None]


def raw_generation(spark, folder):
    """Readings with a type label and an aggregation kind; types not in the list and labels
    with a unit occur."""
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("user_id") % 5 + 1).cast("int"))
    aggs = F.array(*[F.lit(a).cast("string") for a in _AGGS])
    return v.events(spark, folder).select(
        "event_id", "ts", "value", kind.alias("type"), F.element_at(aggs, (F.col("event_id") % 3 + 1).cast("int")).alias("aggregation")
    )


_RAW = """raw AS (SELECT event_id, ts, value,
      (['Hydro Pumped Storage', 'Solar', 'Nuclear', 'Tidal Test Rig', 'Wind Onshore [MW]'])[user_id % 5 + 1] AS type,
      (['Actual Aggregated', 'Actual Consumption', NULL])[event_id % 3 + 1] AS aggregation FROM events),
    routed AS (SELECT event_id, ts, value, CASE
        WHEN aggregation IS NULL THEN trim(split_part(type, ' [', 1))
        WHEN type = 'Hydro Pumped Storage' AND aggregation = 'Actual Aggregated' THEN 'Hydro Pumped Storage_Generation'
        WHEN type = 'Hydro Pumped Storage' AND aggregation = 'Actual Consumption' THEN 'Hydro Pumped Storage_Consumption'
        WHEN aggregation = 'Actual Aggregated' THEN type END AS generation_type FROM raw),
    kept AS (SELECT * FROM routed WHERE generation_type IN ('Hydro Pumped Storage_Generation', 'Hydro Pumped Storage_Consumption', 'Solar', 'Nuclear', 'Wind Onshore'))"""


@query("type_routing", f"WITH {_RAW} SELECT event_id, generation_type, value FROM kept")
def type_routing(spark, folder):
    return c.route_types(raw_generation(spark, folder)).select("event_id", "generation_type", "value")


@query(
    "drop_all_null",
    """SELECT ts, "FR_price", "DE_price" FROM
      (SELECT ts, round("FR_price" + 2.718281828e-8, 6) AS "FR_price", round("DE_price" + 2.718281828e-8, 6) AS "DE_price" FROM {market})
    WHERE "FR_price" IS NOT NULL OR "DE_price" IS NOT NULL""",
)
def drop_all_null(spark, folder):
    kept = c.drop_all_null(v.market(spark, folder).select("ts", "FR_price", "DE_price"), ["FR_price", "DE_price"])
    return kept.select("ts", v.r6("FR_price").alias("FR_price"), v.r6("DE_price").alias("DE_price"))


@query(
    "drop_any_null",
    """SELECT ts, round("FR_price" + 2.718281828e-8, 6) AS "FR_price", round("DE_price" + 2.718281828e-8, 6) AS "DE_price" FROM {market}
    WHERE "FR_price" IS NOT NULL AND "DE_price" IS NOT NULL""",
)
def drop_any_null(spark, folder):
    kept = c.drop_any_null(v.market(spark, folder), "price")
    return kept.select("ts", v.r6("FR_price").alias("FR_price"), v.r6("DE_price").alias("DE_price"))


@query(
    "select_family",
    """SELECT ts, round("FR_Load_forecast" + 2.718281828e-8, 6) AS "FR_Load_forecast", round("FR_Solar_forecast" + 2.718281828e-8, 6) AS "FR_Solar_forecast",
      round("FR_Wind_Onshore_forecast" + 2.718281828e-8, 6) AS "FR_Wind_Onshore_forecast", round("FR_Wind_Offshore_forecast" + 2.718281828e-8, 6) AS "FR_Wind_Offshore_forecast"
    FROM {market}""",
)
def select_family(spark, folder):
    family = c.select_family(v.market(spark, folder), "forecast", ["ts"])
    return family.select("ts", *[v.r6(x).alias(x) for x in family.columns[1:]])


@query(
    "filter_years",
    f"""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE year({local('o_orderdate')}) IN (1996, 1997, 2000)""",
)
def filter_years(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return c.filter_years(orders, "o_orderdate", [1996, 1997, 2000])


@query(
    "filter_range",
    f"""SELECT event_id, ts, value FROM events WHERE {local('ts')} >= TIMESTAMP '2024-01-10'
      AND {local('ts')} < TIMESTAMP '2024-01-21'""",
)
def filter_range(spark, folder):
    rows = v.events(spark, folder).select("event_id", "ts", "value")
    return c.filter_range(rows, "ts", "2024-01-10", "2024-01-20")


@query(
    "threshold_filter",
    f"""SELECT ts, {r6('"FR_price"')} AS "FR_price", {r6('"DE_price"')} AS "DE_price" FROM {{market}}
    WHERE "FR_price" < 60 AND "DE_price" < 60""",
)
def threshold_filter(spark, folder):
    rows = v.market(spark, folder).select("ts", "FR_price", "DE_price")
    kept = c.threshold_filter(rows, c.matching(rows, "price"), 60.0)
    return kept.select("ts", v.r6("FR_price").alias("FR_price"), v.r6("DE_price").alias("DE_price"))


@query(
    "month_key",
    f"""SELECT strftime({local('o_orderdate')}, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1""",
)
def month_key(spark, folder):
    orders = v.table(spark, folder, "orders")
    return orders.groupBy(c.month_key("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "fx_convert",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {r6('l_extendedprice * l_discount')} AS "ARA_EUR" FROM lineitem""",
)
def fx_convert(spark, folder):
    items = v.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("ARA_USD"), F.col("l_discount").alias("USD_EUR")
    )
    return c.fx_convert(items, "ARA_USD", "USD_EUR", "ARA_EUR").withColumn("ARA_EUR", v.r6("ARA_EUR"))


@query(
    "constant_columns",
    f"""SELECT ts, {r6('click')} AS click, {DEFAULT_FUEL['TTF_EUR']}::DOUBLE AS "TTF_EUR", {DEFAULT_FUEL['EUA_EUR']}::DOUBLE AS "EUA_EUR",
      {r6('99.5::DOUBLE * 0.86::DOUBLE')} AS "ARA_EUR" FROM {{wide}}""",
)
def constant_columns(spark, folder):
    rows = v.wide(spark, folder).select("ts", v.r6("click").alias("click"))
    return c.constant_columns(rows).withColumn("ARA_EUR", v.r6("ARA_EUR"))


@query(
    "cyclical_day_week",
    f"""SELECT series, ts, {r6("sin(2 * pi() * epoch(ts) / 86400)")} AS "Day_sin", {r6("cos(2 * pi() * epoch(ts) / 86400)")} AS "Day_cos",
      {r6("sin(2 * pi() * epoch(ts) / 604800)")} AS "Week_sin", {r6("cos(2 * pi() * epoch(ts) / 604800)")} AS "Week_cos" FROM {{hourly}}""",
)
def cyclical_day_week(spark, folder):
    rows = c.cyclical_day_week(v.hourly(spark, folder).drop("value"))
    return rows.select("series", "ts", *[v.r6(x).alias(x) for x in rows.columns[2:]])


_YEAR = f"2 * pi() * epoch(ts) / (CASE WHEN dayofyear(make_date(year({local('ts')})::INT, 12, 31)) = 366 THEN 31622400 ELSE 31536000 END)"


@query(
    "cyclical_year",
    f"""SELECT series, ts, {r6(f"sin({_YEAR})")} AS "Year_sin", {r6(f"cos({_YEAR})")} AS "Year_cos" FROM {{daily}}""",
)
def cyclical_year(spark, folder):
    rows = c.cyclical_year(v.daily(spark, folder).drop("value"))
    return rows.select("series", "ts", *[v.r6(x).alias(x) for x in rows.columns[2:]])


_FLOW = '"FR_DE_flow"'


@query(
    "signed_log",
    f"""SELECT ts, {r6(f'sign({_FLOW}) * ln(1 + abs({_FLOW}))')} AS flow_log FROM {{market}}""",
)
def signed_log(spark, folder):
    return v.market(spark, folder).select("ts", v.r6(c.signed_log("FR_DE_flow")).alias("flow_log"))


@query("signed_exp", f"""SELECT ts, {r6(_FLOW)} AS flow FROM {{market}}""")
def signed_exp(spark, folder):
    """The inverse of ``signed_log`` gives the values back."""
    logged = v.market(spark, folder).select("ts", c.signed_log("FR_DE_flow").alias("x"))
    return logged.select("ts", v.r6(c.signed_exp("x")).alias("flow"))


@query(
    "round2",
    """SELECT event_id, round(value * pi(), 2) AS value FROM events""",
)
def round2(spark, folder):
    return v.events(spark, folder).select("event_id", c.round2(F.col("value") * math.pi).alias("value"))


@query(
    "parse_dmy",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN {local_midnight("o_orderdate + INTERVAL 12 HOUR")} END AS target_date FROM orders""",
)
def parse_dmy(spark, folder):
    """Dates as text; every eleventh order has a month that does not exist."""
    text = F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "dd/13/yyyy")
    )
    return v.table(spark, folder, "orders").select("o_orderkey", c.parse_dmy(text).alias("target_date"))
