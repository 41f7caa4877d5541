"""Market-shaped views of the driver's tables, used by the query catalog.

The tables hold wall-clock stamps; they are read as instants in UTC by declaring the type at
the scan. The load log, the market tables and the blanked cells are derived from the given
rows by fixed rules, stated once here for Spark and once in ``sqlviews`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.functions.columns import cyclical
from tsforge.operators.clean import ffill_bfill
from tsforge.operators.joins import assemble_market
from tsforge.operators.reshape import pivot_entity, resample, resample_grid
from tsforge.operators.windows import make_windows, stack_hours
from tsforge.session import pin_utc
from tsforge.sources.io import scan

_DDL = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
        "l_linestatus STRING, l_shipdate TIMESTAMP"
    ),
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}
TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CODES = ["FR", "DE", "ES", "IT"]
FORECASTS = ["Solar", "Wind Onshore", "Wind Offshore"]
PAIRS = [("FR", "DE"), ("DE", "FR"), ("FR", "ES"), ("ES", "FR"), ("FR", "IT"), ("IT", "FR")]
MARKET_COLUMNS = [
    "FR_price",
    "DE_price",
    "FR_Load_forecast",
    "FR_Solar_forecast",
    "FR_Wind_Onshore_forecast",
    "FR_Wind_Offshore_forecast",
    "FR_DE_flow",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return scan(pin_utc(spark), f"{folder}/{name}.parquet", _DDL[name])


def r6(column: Column | str) -> Column:
    """Rounded to 6 places after a tiny shift, as in ``sqlviews.r6``."""
    return F.round((F.col(column) if isinstance(column, str) else column) + 2.718281828e-8, 6)


# ------------------------------------------------------------------- hourly


def events(spark, folder) -> DataFrame:
    return table(spark, folder, "events")


def hourly(spark, folder) -> DataFrame:
    """``(series, ts, value)``: hourly mean per event type, with holes."""
    return resample(events(spark, folder).withColumnRenamed("event_type", "series"), ["series"], "ts")


def hourly_all(spark, folder) -> DataFrame:
    return resample(events(spark, folder).withColumn("series", F.lit("ALL")), ["series"], "ts")


def gridded(spark, folder) -> DataFrame:
    """The same on a gapless grid, empty hours null."""
    return resample_grid(events(spark, folder).withColumnRenamed("event_type", "series"), ["series"], "ts")


def filled(spark, folder) -> DataFrame:
    return ffill_bfill(gridded(spark, folder), ["series"], "ts", ["value"])


def wide(spark, folder) -> DataFrame:
    """One row per hour, one column per event type."""
    rows = filled(spark, folder)
    named = pivot_entity(rows, ["ts"], "series", TYPES, ["value"])
    return named.withColumnsRenamed({f"{t}_value": t for t in TYPES})


def hour_number(ts: str = "ts") -> Column:
    return F.floor(F.unix_seconds(ts) / 3600)


def market(spark, folder) -> DataFrame:
    """Seven market-like columns with holes: single hours, pairs of hours and, for offshore
    wind, most of the time."""
    h = hour_number()
    return wide(spark, folder).select(
        "ts",
        F.when(h % 37 != 0, F.col("view")).alias("FR_price"),
        F.when(h % 41 != 0, F.col("purchase")).alias("DE_price"),
        F.when(h % 43 != 0, F.col("click")).alias("FR_Load_forecast"),
        F.when((h % 19 != 0) & (h % 95 != 1), F.col("error")).alias("FR_Solar_forecast"),
        F.when(h % 23 != 0, F.col("signup")).alias("FR_Wind_Onshore_forecast"),
        F.when(h % 5 == 0, F.col("signup") / 2).alias("FR_Wind_Offshore_forecast"),
        F.when(h % 47 != 0, F.col("error") - F.col("signup")).alias("FR_DE_flow"),
    )


# -------------------------------------------------------------------- daily


def daily(spark, folder) -> DataFrame:
    """``(series, ts, value)``: sum of order prices per priority and day."""
    orders = table(spark, folder, "orders")
    return resample(
        orders.select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"), "o_totalprice"),
        ["series"],
        "ts",
        "day",
        {"value": F.sum("o_totalprice")},
    )


def month_prices(spark, folder) -> DataFrame:
    """``(Month, EUA_EUR, TTF_EUR, ARA_EUR)`` from line items, per UTC month of shipping."""
    items = table(spark, folder, "lineitem")
    return items.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("Month")).agg(
        F.avg("l_quantity").alias("EUA_EUR"),
        F.avg("l_discount").alias("TTF_EUR"),
        F.avg("l_tax").alias("ARA_EUR"),
    )


# ------------------------------------------------------------ market tables


def _pick(index: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def prices(spark, folder) -> DataFrame:
    names = ["France", "Germany", "Germany_Luxembourg", "Spain", "Italy_North"]
    return events(spark, folder).where("event_type = 'view'").select(
        F.col("ts").alias("timestamp"),
        _pick(F.col("user_id") % 5, names).alias("country"),
        F.col("value").alias("price"),
        F.lit("EUR/MWh").alias("unit"),
    )


_FOUR = ["France", "Germany", "Spain", "Italy"]


def load(spark, folder) -> DataFrame:
    return events(spark, folder).where("event_type = 'click'").select(
        F.col("ts").alias("timestamp"),
        _pick(F.col("user_id") % 4, _FOUR).alias("country"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("actual_load"),
        (F.col("value") * 1.1).alias("forecast_load"),
        F.lit("MW").alias("unit"),
    )


def wind_solar(spark, folder) -> DataFrame:
    return events(spark, folder).where("event_type = 'purchase'").select(
        F.col("ts").alias("timestamp"),
        _pick(F.col("user_id") % 4, _FOUR).alias("country"),
        _pick(F.floor(F.col("user_id") / 4) % 3, FORECASTS).alias("forecast_type"),
        "value",
        F.lit("MW").alias("unit"),
    )


def generation(spark, folder) -> DataFrame:
    kinds = ["Nuclear", "Solar", "Wind Onshore", "Fossil Gas", "Waste"]
    return events(spark, folder).select(
        F.col("ts").alias("timestamp"),
        _pick(F.col("user_id") % 4, _FOUR).alias("country"),
        _pick(F.col("event_id") % 5, kinds).alias("generation_type"),
        "value",
        F.lit("MW").alias("unit"),
    )


def flows(spark, folder) -> DataFrame:
    """Directed flows of the hub with neighbours, two names of one neighbour and one
    neighbour that has no code."""
    neighbour = _pick(
        F.floor(F.col("user_id") / 2) % 5, ["Germany", "Germany_Luxembourg", "Spain", "Italy", "Atlantis"]
    )
    outgoing = F.col("user_id") % 2 == 0
    return events(spark, folder).where("event_type in ('error', 'signup')").select(
        F.col("ts").alias("timestamp"),
        F.when(outgoing, F.lit("France")).otherwise(neighbour).alias("country_from"),
        F.when(outgoing, neighbour).otherwise(F.lit("France")).alias("country_to"),
        F.col("value").alias("flow"),
        F.lit("MW").alias("unit"),
    )


def market_tables(spark, folder) -> dict[str, DataFrame]:
    return {
        "day_ahead_prices": prices(spark, folder),
        "load_data": load(spark, folder),
        "generation_data": generation(spark, folder),
        "wind_solar_forecast": wind_solar(spark, folder),
        "crossborder_flows": flows(spark, folder),
    }


def assembled(spark, folder) -> DataFrame:
    return assemble_market(
        prices(spark, folder),
        load(spark, folder),
        wind_solar(spark, folder),
        flows(spark, folder),
        CODES,
        FORECASTS,
        PAIRS,
    )


def trade(spark, folder) -> DataFrame:
    """Goods moved from customer nation to supplier nation per month: directed pairs."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    nation = table(spark, folder, "nation")
    buyers = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sellers = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyers.select("c_custkey", F.col("n_name").alias("country_from")), F.col("o_custkey") == F.col("c_custkey"))
        .join(sellers.select("s_suppkey", F.col("n_name").alias("country_to")), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.date_trunc("month", "o_orderdate").alias("timestamp"), "country_from", "country_to")
        .agg(F.sum("l_extendedprice").alias("flow"))
    )


# ----------------------------------------------------------------- load log


def chunk_log(spark, folder) -> DataFrame:
    """One line per priority, order status and quarter that has orders; every seventh count
    is logged as an error."""
    orders = table(spark, folder, "orders")
    start = F.date_trunc("quarter", "o_orderdate")
    lines = orders.groupBy(
        F.col("o_orderpriority").alias("country"), F.col("o_orderstatus").alias("data_type"), start.alias("start_date")
    ).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("download_timestamp"))
    return lines.select(
        "country",
        "data_type",
        "start_date",
        (F.col("start_date") + F.expr("INTERVAL 3 MONTHS")).alias("end_date"),
        "download_timestamp",
        F.when(F.col("n") % 7 == 0, "error").otherwise("success").alias("status"),
    )


# ----------------------------------------------------- windows and forecasts


def windows(spark, folder, require_end: bool = True) -> DataFrame:
    """168/24 windows of ``value`` per event type on the filled grid."""
    rows = cyclical(filled(spark, folder))
    return make_windows(
        rows,
        ["series"],
        "ts",
        ["value", "Day_sin"],
        ["Day_sin", "Day_cos"],
        "value",
        require_end=require_end,
        dedupe=False,
    )


def naive_forecast(spark, folder) -> DataFrame:
    """Windows with ``predicted``: the value one week before each horizon hour, which is the
    first day of the history."""
    first_day = F.transform(F.slice("past", 1, 24), lambda r: r["value"])
    return windows(spark, folder).withColumn("predicted", first_day)


def scored(spark, folder) -> DataFrame:
    """``(series, anchor, hour, y, predicted)`` of the weekly naive forecast."""
    return stack_hours(naive_forecast(spark, folder), ["series", "anchor", "window_date"], ["y", "predicted"])


def daily_windows(spark, folder) -> DataFrame:
    """The window index (series, anchor, window_date) of the daily order series: each day
    with orders stands for one daily forecast origin, long enough for calendar splits."""
    return daily(spark, folder).select(
        "series", F.col("ts").alias("anchor"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("window_date"), "value"
    )
