"""Order-aware cleaning."""

from pyspark.sql import functions as F

from tsforge.operators import clean as k
from tsforge.operators.reshape import pivot_entity
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.catalog.quality import CLEAN_SQL
from tsforge.plans.sqlviews import local, r6

S, TS = ["series"], "ts"


def _value(df):
    return df.withColumn("value", v.r6("value"))


@query("mean_duplicates", f"SELECT series, ts, {r6('value')} AS value FROM {{hourly}}")
def mean_duplicates(spark, folder):
    rows = v.events(spark, folder).select(
        F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("ts"), "value"
    )
    return _value(k.mean_duplicates(rows, S, TS, ["value"]))


@query(
    "fill_prior_week",
    f"""SELECT a.series, a.ts, {r6('coalesce(a.value, p.value)')} AS value,
      (a.value IS NULL AND p.value IS NOT NULL)::INTEGER AS filled
    FROM {{gridded}} a LEFT JOIN {{gridded}} p ON p.series = a.series AND p.ts = a.ts - INTERVAL 168 HOUR""",
)
def fill_prior_week(spark, folder):
    return _value(k.fill_prior_week(v.gridded(spark, folder), S, TS, ["value"], flag="filled"))


@query(
    "neighbour_interpolate",
    f"""SELECT a.series, a.ts, {r6('coalesce(a.value, (p.value + n.value) / 2)')} AS value,
      (a.value IS NULL AND p.value IS NOT NULL AND n.value IS NOT NULL)::INTEGER AS filled
    FROM {{gridded}} a LEFT JOIN {{gridded}} p ON p.series = a.series AND p.ts = a.ts - INTERVAL 1 HOUR
      LEFT JOIN {{gridded}} n ON n.series = a.series AND n.ts = a.ts + INTERVAL 1 HOUR""",
)
def neighbour_interpolate(spark, folder):
    return _value(k.neighbour_interpolate(v.gridded(spark, folder), S, TS, ["value"], flag="filled"))


@query(
    "fill_constant",
    f"""SELECT ts, {r6('coalesce("FR_Wind_Offshore_forecast", 0.0)')} AS "FR_Wind_Offshore_forecast" FROM {{market}}""",
)
def fill_constant(spark, folder):
    rows = v.market(spark, folder).select("ts", "FR_Wind_Offshore_forecast")
    done = k.fill_constant(rows, "FR_Wind_Offshore_forecast")
    return done.withColumn("FR_Wind_Offshore_forecast", v.r6("FR_Wind_Offshore_forecast"))


_RAGGED = ", ".join(f"max(value) FILTER (WHERE series = '{t}') AS \"{t}_value\"" for t in v.TYPES)


@query(
    "drop_entity_all_null",
    f"""SELECT ts, {", ".join(f'round("{t}_value" + 2.718281828e-8, 6) AS "{t}_value"' for t in v.TYPES)}
    FROM (SELECT ts, {_RAGGED} FROM {{hourly}} GROUP BY ts)
    WHERE NOT ("click_value" IS NULL AND "error_value" IS NULL) AND NOT ("purchase_value" IS NULL)
      AND NOT ("signup_value" IS NULL AND "view_value" IS NULL)""",
)
def drop_entity_all_null(spark, folder):
    rows = pivot_entity(v.hourly(spark, folder), ["ts"], "series", v.TYPES, ["value"])
    families = {
        "A": ["click_value", "error_value"],
        "B": ["purchase_value"],
        "C": ["signup_value", "view_value"],
    }
    kept = k.drop_entity_all_null(rows, families)
    return kept.select("ts", *[v.r6(c).alias(c) for c in kept.columns[1:]])


@query(
    "ffill",
    f"""SELECT series, ts, {r6('''last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''')} AS value FROM {{gridded}}""",
)
def ffill(spark, folder):
    return _value(k.ffill(v.gridded(spark, folder), S, TS, ["value"]))


_HOLES = """CASE WHEN epoch(ts)::BIGINT // 86400 % 9 < 4 THEN NULL ELSE value END"""


@query(
    "ffill_bfill",
    f"""WITH h AS (SELECT series, ts, {_HOLES} AS value FROM {{daily}})
    SELECT series, ts, {r6('''coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))''')} AS value FROM h""",
)
def ffill_bfill(spark, folder):
    """Seven years of days with four of every nine blanked: fills cross bucket edges."""
    day = F.floor(F.unix_seconds("ts") / 86400)
    rows = v.daily(spark, folder).withColumn("value", F.when(day % 9 >= 4, F.col("value")))
    return _value(k.ffill_bfill(rows, S, TS, ["value"]))


@query(
    "dedupe_first",
    """SELECT event_type AS series, date_trunc('hour', ts) AS ts, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value
    FROM events GROUP BY 1, 2""",
)
def dedupe_first(spark, folder):
    rows = v.events(spark, folder).select(
        F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("ts"), "event_id", "value"
    )
    return k.dedupe_first(rows, ["series", "ts"], ["event_id"])


_MONTHLY = f"SELECT series, strftime({local('ts')}, '%Y-%m') AS month, avg(value) AS mean FROM {{daily}} GROUP BY 1, 2"


@query(
    "monthly_stats",
    f"""WITH m AS ({_MONTHLY}) SELECT series, month, {r6('mean')} AS mean,
      round(CASE WHEN count(*) OVER w = 3 THEN avg(mean) OVER w END + 2.718281828e-8, 6) AS rolling_mean FROM m
    WINDOW w AS (PARTITION BY series ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def monthly_stats(spark, folder):
    stats = k.monthly_stats(v.daily(spark, folder), TS, "value", S)
    return stats.withColumns({c: v.r6(c) for c in ("mean", "rolling_mean")})


@query(
    "drop_high_months",
    f"""WITH d AS (SELECT o_orderpriority AS series, o_orderdate AS ts, avg(o_totalprice) AS "FR_price" FROM orders GROUP BY 1, 2),
    kept AS (SELECT *, strftime({local('ts')}, '%Y-%m') AS month FROM d WHERE "FR_price" < 450000),
    m AS (SELECT month, avg("FR_price") AS mean FROM kept GROUP BY 1),
    rolled AS (SELECT month, CASE WHEN count(*) OVER w = 3 THEN avg(mean) OVER w END AS rolling FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT series, ts, {r6('"FR_price"')} AS "FR_price" FROM kept WHERE month NOT IN (SELECT month FROM rolled WHERE rolling > 245000)""",
)
def drop_high_months(spark, folder):
    orders = v.table(spark, folder, "orders")
    rows = orders.groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts")).agg(
        F.avg("o_totalprice").alias("FR_price")
    )
    kept = k.drop_high_months(rows, TS, "FR_price", limit=450000.0, month_limit=245000.0)
    return kept.withColumn("FR_price", v.r6("FR_price"))


_MARKET = ", ".join(f'{r6(chr(34) + c + chr(34))} AS "{c}"' for c in v.MARKET_COLUMNS)


def _market(df):
    return df.select("ts", *[v.r6(c).alias(c) for c in v.MARKET_COLUMNS])


@query(
    "clean_drop_only",
    f"""SELECT ts, {_MARKET} FROM (SELECT * REPLACE (coalesce("FR_Wind_Offshore_forecast", 0.0) AS "FR_Wind_Offshore_forecast") FROM {{market}})
    WHERE "FR_Solar_forecast" IS NOT NULL AND "FR_Wind_Onshore_forecast" IS NOT NULL AND "FR_price" IS NOT NULL
      AND "DE_price" IS NOT NULL AND "FR_Load_forecast" IS NOT NULL""",
)
def clean_drop_only(spark, folder):
    return _market(k.clean_drop_only(v.market(spark, folder), "FR_Wind_Offshore_forecast"))


@query("clean_full", f"WITH {CLEAN_SQL} SELECT ts, {_MARKET} FROM r4")
def clean_full(spark, folder):
    return _market(k.clean_full(v.market(spark, folder)))
