"""Lags and column roles."""

from pyspark.sql import functions as F

from tsforge.constants import LAG_HOURS
from tsforge.functions.columns import cyclical
from tsforge.operators import features as f
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import r6
from tsforge.sources.io import roles_from

_LAGS = ", ".join(
    f"""round(max(value) OVER (PARTITION BY series ORDER BY ts RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND INTERVAL {h} HOUR PRECEDING) + 2.718281828e-8, 6) AS "value_lag_{h}h" """
    for h in LAG_HOURS
)


def _rounded(df):
    return df.select("series", "ts", *[v.r6(c).alias(c) for c in df.columns[2:]])


@query("time_lags", f"SELECT series, ts, {r6('value')} AS value, {_LAGS} FROM {{hourly}}")
def time_lags(spark, folder):
    return _rounded(f.time_lags(v.hourly(spark, folder), ["series"], "ts", "value"))


_WHOLE = " AND ".join(f'"value_lag_{h}h" IS NOT NULL' for h in LAG_HOURS)


@query(
    "drop_incomplete_lags",
    f"SELECT * FROM (SELECT series, ts, {r6('value')} AS value, {_LAGS} FROM {{hourly_all}}) WHERE {_WHOLE}",
)
def drop_incomplete_lags(spark, folder):
    return _rounded(f.drop_incomplete_lags(f.time_lags(v.hourly_all(spark, folder), ["series"], "ts", "value")))


@query(
    "feature_roles",
    """WITH m AS (SELECT * FROM {market}), k AS (
      SELECT unnest(['FR_price', 'DE_price', 'FR_DE_flow', 'FR_Load_forecast', 'FR_Solar_forecast', 'FR_Wind_Onshore_forecast', 'FR_Wind_Offshore_forecast',
          'Day_sin', 'Day_cos', 'Week_sin', 'Week_cos', 'Year_sin', 'Year_cos']) AS "column",
        unnest([count("FR_price"), count("DE_price"), count("FR_DE_flow"), count("FR_Load_forecast"), count("FR_Solar_forecast"),
          count("FR_Wind_Onshore_forecast"), count("FR_Wind_Offshore_forecast"), count(*), count(*), count(*), count(*), count(*), count(*)]) AS known,
        unnest(range(13)) AS i FROM m)
    SELECT 'past' AS role, i::INTEGER AS position, "column", known FROM k WHERE i < 3
    UNION ALL SELECT 'future', (i - 3)::INTEGER, "column", known FROM k WHERE i >= 3
    UNION ALL SELECT 'target', 0, "column", known FROM k WHERE i = 0""",
)
def feature_roles(spark, folder):
    """Roles with past features limited to what the future does not know."""
    rows = cyclical(v.market(spark, folder))
    past, future, target = f.feature_roles(rows, "FR_price", exclude_known=True)
    return roles_from(rows, target, past, future)


@query(
    "align_columns",
    """SELECT ts, round("FR_DE_flow" + 2.718281828e-8, 6) AS "FR_DE_flow", round("FR_Solar_forecast" + 2.718281828e-8, 6) AS "FR_Solar_forecast", round("FR_price" + 2.718281828e-8, 6) AS "FR_price"
    FROM {market}""",
)
def align_columns(spark, folder):
    aligned = f.align_columns(v.market(spark, folder), ["FR_DE_flow", "FR_Solar_forecast", "FR_price"], ["ts"])
    return aligned.select("ts", *[v.r6(c).alias(c) for c in aligned.columns[1:]])
