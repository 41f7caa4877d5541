"""Joins."""

from pyspark.sql import functions as F

from tsforge.operators import joins as j
from tsforge.operators.reshape import pivot_entity, resample
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import local, r6


def _by_country(df, column):
    return resample(df, ["country"], "timestamp", "hour", [column])


_H = """SELECT date_trunc('hour', "timestamp") AS "timestamp", country, avg({c}) AS {c} FROM {{{t}}} GROUP BY 1, 2"""


@query(
    "merge_outer",
    f"""WITH p AS ({_H.format(c='price', t='prices')}), l AS ({_H.format(c='forecast_load', t='load')}),
      w AS ({_H.format(c='value', t='wind_solar')})
    SELECT "timestamp", country, {r6('price')} AS price, {r6('forecast_load')} AS forecast_load, {r6('value')} AS value
    FROM p FULL JOIN l USING ("timestamp", country) FULL JOIN w USING ("timestamp", country)""",
)
def merge_outer(spark, folder):
    frames = [
        _by_country(v.prices(spark, folder), "price"),
        _by_country(v.load(spark, folder), "forecast_load"),
        _by_country(v.wind_solar(spark, folder), "value"),
    ]
    merged = j.merge_outer(frames, ["timestamp", "country"])
    return merged.select("timestamp", "country", *[v.r6(c).alias(c) for c in merged.columns[2:]])


@query(
    "merge_outer_ts",
    f"""WITH a AS (SELECT ts, max(value) FILTER (WHERE series = 'click') AS click_value, max(value) FILTER (WHERE series = 'view') AS view_value
      FROM {{hourly}} WHERE series IN ('click', 'view') GROUP BY 1),
    b AS (SELECT date_trunc('hour', "timestamp") AS ts, avg(flow) AS flow FROM {{flows}} GROUP BY 1)
    SELECT ts, {r6('click_value')} AS click_value, {r6('view_value')} AS view_value, {r6('flow')} AS flow FROM a FULL JOIN b USING (ts)""",
)
def merge_outer_ts(spark, folder):
    rows = v.hourly(spark, folder).where(F.col("series").isin("click", "view"))
    wide = pivot_entity(rows, ["ts"], "series", ["click", "view"], ["value"])
    flows = resample(v.flows(spark, folder).withColumnRenamed("timestamp", "ts"), [], "ts", "hour", ["flow"])
    merged = j.merge_outer_ts(wide, flows)
    return merged.select("ts", *[v.r6(c).alias(c) for c in merged.columns[1:]])


@query(
    "multi_left_join",
    f"""WITH o AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*) AS orders FROM orders GROUP BY 1),
    s AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1),
    q AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, avg(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    t AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, avg(l_tax) AS tax FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT day, orders, {r6('price')} AS price, {r6('quantity')} AS quantity, {r6('tax')} AS tax
    FROM o LEFT JOIN s USING (day) LEFT JOIN q USING (day) LEFT JOIN t USING (day)""",
)
def multi_left_join(spark, folder):
    items = v.table(spark, folder, "lineitem")

    def per_day(rows, column, name):
        return rows.groupBy(F.date_trunc("day", "l_shipdate").alias("day")).agg(F.avg(column).alias(name))

    base = v.table(spark, folder, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("day"))
    joined = j.multi_left_join(
        base.agg(F.count(F.lit(1)).alias("orders")),
        [
            per_day(items, "l_extendedprice", "price"),
            per_day(items.where("l_returnflag = 'R'"), "l_quantity", "quantity"),
            per_day(items.where("l_linestatus = 'F'"), "l_tax", "tax"),
        ],
        "day",
    )
    return joined.select("day", "orders", *[v.r6(c).alias(c) for c in ("price", "quantity", "tax")])


@query(
    "month_lookup",
    f"""SELECT d.series, d.ts, {r6('d.value')} AS value, {r6('m."EUA_EUR"')} AS "EUA_EUR", {r6('m."TTF_EUR"')} AS "TTF_EUR",
      {r6('m."ARA_EUR"')} AS "ARA_EUR" FROM {{daily}} d LEFT JOIN {{month_prices}} m ON strftime({local('d.ts')}, '%Y-%m') = m."Month" """,
)
def month_lookup(spark, folder):
    joined = j.month_lookup(v.daily(spark, folder), v.month_prices(spark, folder), "ts")
    return joined.select("series", "ts", *[v.r6(c).alias(c) for c in ("value", "EUA_EUR", "TTF_EUR", "ARA_EUR")])


@query(
    "anti_months",
    f"""WITH m AS (SELECT strftime({local('ts')}, '%Y-%m') AS month, avg(value) AS mean FROM {{daily}} GROUP BY 1),
    high AS (SELECT month FROM m WHERE mean > (SELECT avg(mean) FROM m))
    SELECT series, ts, {r6('value')} AS value FROM {{daily}} WHERE strftime({local('ts')}, '%Y-%m') NOT IN (SELECT month FROM high)""",
)
def anti_months(spark, folder):
    from tsforge.functions.columns import month_key

    rows = v.daily(spark, folder)
    months = rows.groupBy(month_key("ts").alias("month")).agg(F.avg("value").alias("mean"))
    high = months.where(F.col("mean") > months.agg(F.avg("mean")).scalar())
    return j.anti_months(rows, high, "ts").withColumn("value", v.r6("value"))


_COLUMNS = [f"{c}_{m}" for c in v.CODES for m in ("price", "Load_forecast", "Solar_forecast", "Wind_Onshore_forecast", "Wind_Offshore_forecast")]
_COLUMNS += [f"{a}_{b}_flow" for a, b in v.PAIRS]
_WIDE = ", ".join(f"""{r6(f"max(v) FILTER (WHERE col = '{c}')")} AS "{c}" """ for c in _COLUMNS)


@query("assemble_market", f"SELECT ts, {_WIDE} FROM {{cells}} GROUP BY ts")
def assemble_market(spark, folder):
    wide = v.assembled(spark, folder)
    return wide.select("ts", *[v.r6(c).alias(c) for c in _COLUMNS])
