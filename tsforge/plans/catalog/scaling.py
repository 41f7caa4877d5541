"""Imputation and scaling."""

from pyspark.sql import functions as F

from tsforge.functions.columns import cyclical
from tsforge.operators import scaling as n
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import r6
from tsforge.session import materialise, scratch_path


def _rounded(df, keys=("ts",)):
    return df.select(*keys, *[v.r6(c).alias(c) for c in df.columns if c not in keys])


_PRICES = ["FR_price", "DE_price", "FR_Solar_forecast"]


@query(
    "impute_constant",
    "SELECT ts, " + ", ".join(f'coalesce(round("{c}" + 2.718281828e-8, 6), 0.0) AS "{c}"' for c in _PRICES) + " FROM {market}",
)
def impute_constant(spark, folder):
    return _rounded(n.impute_constant(v.market(spark, folder).select("ts", *_PRICES), _PRICES))


_PAST = """p AS (SELECT series, anchor, ts, value, sin(2 * pi() * epoch(ts) / 86400) AS sine FROM {past_hours})"""
_FIT = f"""{_PAST}, fit AS (SELECT avg(value) AS m, stddev_pop(value) AS s, avg(sine) AS ms, stddev_pop(sine) AS ss FROM p)"""


@query(
    "standard_fit",
    f"""WITH {_FIT} SELECT 'value' AS feature, {r6('m')} AS mean, {r6('s')} AS scale FROM fit
    UNION ALL SELECT 'Day_sin', {r6('ms')}, {r6('ss')} FROM fit""",
)
def standard_fit(spark, folder):
    fitted = n.standard_fit_windows(v.windows(spark, folder), "past", ["value", "Day_sin"])
    return fitted.withColumns({c: v.r6(c) for c in ("mean", "scale")})


@query(
    "standard_apply",
    f"""WITH {_FIT} SELECT series, anchor, ts, {r6('(value - m) / s')} AS value, {r6('(sine - ms) / ss')} AS "Day_sin" FROM p, fit""",
)
def standard_apply(spark, folder):
    """The windows are written once; the fit and the application read them."""
    windows = materialise(v.windows(spark, folder).select("series", "anchor", "past"), "windows")
    fitted = n.standard_fit_windows(windows, "past", ["value", "Day_sin"])
    scaled = n.standard_apply_windows(windows, "past", fitted, ["value", "Day_sin"])
    hours = scaled.select("series", "anchor", F.explode("past").alias("h")).select("series", "anchor", "h.*")
    return _rounded(hours, ("series", "anchor", "ts"))


_FUTURE = """f AS (SELECT y, sin(2 * pi() * epoch(anchor + INTERVAL (hour) HOUR) / 86400) AS sine, cos(2 * pi() * epoch(anchor + INTERVAL (hour) HOUR) / 86400) AS cosine FROM {scored})"""


@query(
    "standard_fit_parts",
    f"""WITH {_FIT}, {_FUTURE} SELECT 'past' AS part, 'value' AS feature, {r6('m')} AS mean, {r6('s')} AS scale FROM fit
    UNION ALL SELECT 'past', 'Day_sin', {r6('ms')}, {r6('ss')} FROM fit
    UNION ALL SELECT 'future', 'Day_sin', {r6('avg(sine)')}, {r6('stddev_pop(sine)')} FROM f
    UNION ALL SELECT 'future', 'Day_cos', {r6('avg(cosine)')}, {r6('stddev_pop(cosine)')} FROM f
    UNION ALL SELECT 'y', 'y', {r6('avg(y)')}, {r6('stddev_pop(y)')} FROM f""",
)
def standard_fit_parts(spark, folder):
    """Scalers of history, horizon and target from one pass."""
    parts = {"past": ["value", "Day_sin"], "future": ["Day_sin", "Day_cos"], "y": None}
    fitted = n.standard_fit_parts(v.windows(spark, folder), parts)
    return fitted.withColumns({c: v.r6(c) for c in ("mean", "scale")})


@query(
    "impute_mean",
    "SELECT ts, " + ", ".join(r6(f'coalesce("{c}", (SELECT avg("{c}") FROM {{market}}))') + f' AS "{c}"' for c in _PRICES) + " FROM {market}",
)
def impute_mean(spark, folder):
    return _rounded(n.impute_mean(v.market(spark, folder).select("ts", *_PRICES), _PRICES))


_FILLED = ", ".join(f'coalesce("{c}", (SELECT avg("{c}") FROM {{market}})) AS "{c}"' for c in _PRICES)
_STD = ", ".join(r6(f'("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER ()') + f' AS "{c}"' for c in _PRICES)


@query(
    "scale_passthrough",
    f"""SELECT ts, {_STD}, {r6('sin(2 * pi() * epoch(ts) / 86400)')} AS "Day_sin" FROM (SELECT ts, {_FILLED} FROM {{market}})""",
)
def scale_passthrough(spark, folder):
    rows = cyclical(v.market(spark, folder)).select("ts", *_PRICES, "Day_sin")
    return _rounded(n.scale_passthrough(rows, [*_PRICES, "Day_sin"]))


@query(
    "target_scale",
    f"""SELECT series, anchor, hour, {r6('(y - (SELECT avg(y) FROM {scored})) / (SELECT stddev_pop(y) FROM {scored})')} AS y FROM {{scored}}""",
)
def target_scale(spark, folder):
    windows = v.windows(spark, folder)
    scaled = n.target_scale(windows, n.target_fit(windows))
    return _rounded(v.stack_hours(scaled, ["series", "anchor"], ["y"]), ("series", "anchor", "hour"))


@query("target_unscale", f"SELECT series, anchor, hour, {r6('y')} AS y FROM {{scored}}")
def target_unscale(spark, folder):
    windows = v.windows(spark, folder)
    params = n.target_fit(windows)
    back = n.target_unscale(n.target_scale(windows, params), params)
    return _rounded(v.stack_hours(back, ["series", "anchor"], ["y"]), ("series", "anchor", "hour"))


@query(
    "scaler_reload",
    "SELECT ts, "
    + ", ".join(
        r6(f'(coalesce("{c}", 0) - (SELECT avg(coalesce("{c}", 0)) FROM {{market}})) / (SELECT stddev_pop(coalesce("{c}", 0)) FROM {{market}})') + f' AS "{c}"'
        for c in _PRICES
    )
    + " FROM {market}",
)
def scaler_reload(spark, folder):
    rows = v.market(spark, folder).select("ts", *_PRICES)
    path = scratch_path(spark, "scaler")
    n.save_scaler(n.standard_fit(rows, _PRICES), path)
    return _rounded(n.standard_apply(rows, n.load_scaler(spark, path), _PRICES))


_MONEY = ["l_quantity", "l_extendedprice", "l_tax"]


@query(
    "robust_scale",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        r6(f"({c} - (SELECT quantile_cont({c}, 0.5) FROM lineitem)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)") + f" AS {c}"
        for c in _MONEY
    )
    + " FROM lineitem",
)
def robust_scale(spark, folder):
    keys = ("l_orderkey", "l_linenumber", "l_partkey")
    items = v.table(spark, folder, "lineitem").select(*keys, *_MONEY)
    return _rounded(n.robust_scale(items, n.robust_fit(items, _MONEY), _MONEY), keys)
