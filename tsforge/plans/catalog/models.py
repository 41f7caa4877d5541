"""Forecasters."""

import numpy as np
from pyspark.sql import functions as F

from tsforge.functions.columns import signed_log
from tsforge.operators import models as m
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import r6
from tsforge.session import materialise

_FLAGS = {"many_clicks": "click", "many_errors": "error"}


@query(
    "gbt_fit_predict",
    """WITH f AS (SELECT ts, "view" AS y, (coalesce(click, 0) > 50)::INT AS a, (coalesce(error, 0) > 50)::INT AS b FROM {wide}),
    m AS (SELECT a, b, avg(y) AS m FROM f WHERE day(ts) <= 20 GROUP BY 1, 2)
    SELECT ts, round(m + 2.718281828e-8, 6) AS prediction FROM f LEFT JOIN m USING (a, b)""",
)
def gbt_fit_predict(spark, folder):
    """100 rounds of depth 5 at rate 0.1 on 0/1 features: the first tree holds the mean of each
    combination and later ones add nothing, so group means check the fit. Fitted on the first
    twenty days, predicted for all; the rows are written once because every round reads them."""
    flags = {n: (F.coalesce(c, F.lit(0.0)) > 50).cast("double") for n, c in _FLAGS.items()}
    rows = materialise(v.wide(spark, folder).withColumns(flags).select("ts", "view", *_FLAGS), "gbt")
    found = m.gbt_fit_predict(rows.where("day(ts) <= 20"), rows, list(_FLAGS), "view")
    return found.select("ts", v.r6("prediction").alias("prediction"))


def _drawn(name):
    lo, hi, kind = m.SEARCH_SPACE[name]
    unit = f"(('0x' || substr(md5(series || '|' || d || '|{name}'), 1, 12))::BIGINT / pow(16, 12))"
    if kind == "int":
        return f'floor({lo} + {unit} * {hi - lo + 1})::INTEGER AS "{name}"'
    value = f"{lo} + {unit} * ({hi} - {lo})" if kind == "float" else f"exp(ln({lo}) + {unit} * (ln({hi}) - ln({lo})))"
    return f'{r6(value)} AS "{name}"'


@query(
    "search_draws",
    f"SELECT series, d::INTEGER AS draw, {', '.join(map(_drawn, m.SEARCH_SPACE))} FROM (SELECT DISTINCT event_type AS series FROM events), range(20) t(d)",
)
def search_draws(spark, folder):
    """The 20 draws of a parameter search of each series, at the search's own ranges. The search itself fits 20 times
    5 models of up to 1000 rounds, too much for a check; ``tests/test_models.py`` runs it in a small space."""
    whole = [n for n, (_, _, kind) in m.SEARCH_SPACE.items() if kind == "int"]
    series = v.events(spark, folder).select(F.col("event_type").alias("series"))
    drawn = m.draw_table(series, "series", 20)
    return drawn.select("series", "draw", *[c if c in whole else v.r6(c).alias(c) for c in m.SEARCH_SPACE])


@query("ar_mimo", "SELECT h.hour::INT AS hour, l.lag::INT AS lag, 0.0::DOUBLE AS gap FROM range(24) h(hour), range(48) l(lag)")
def ar_mimo(spark, folder, lags=48, ridge=1e-6):
    """48 lags to 24 hours, fitted on the windows of the first twenty days. At the solution the
    residuals are orthogonal to every lag, up to the penalty."""
    train = v.windows(spark, folder).where("day(anchor) <= 20")
    model = m.ar_fit(train, "value", lags, ridge=ridge)
    scored = m.score_windows(train, model, m.last_values("value", lags))
    left = scored.withColumn("y", F.zip_with("y", "predicted", lambda y, p: y - p))
    cells = m.moments_of(left, m.last_values("value", lags), "y", lags, 24).where(f"i < {lags} AND j > {lags}")
    weights = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in model.weights])
    hour = F.col("j") - lags - 1
    penalty = ridge * F.get(F.get(weights, F.col("i")), hour)
    return cells.select(
        hour.cast("int").alias("hour"), F.col("i").alias("lag"), (F.round(F.col("v") - penalty, 1) + 0.0).alias("gap")
    )


@query(
    "ar_mimo_one_lag",
    f"""WITH x AS (SELECT s.series, s.anchor, s.hour, s.y, f.value AS x FROM {{scored}} s JOIN {{filled}} f ON f.series = s.series AND f.ts = s.anchor - INTERVAL 1 HOUR),
    fit AS (SELECT hour, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM x GROUP BY 1)
    SELECT series, anchor, hour, round(a * x + b, 4) + 0.0 AS predicted FROM x JOIN fit USING (hour)""",
)
def ar_mimo_one_lag(spark, folder):
    """One lag and no ridge is simple regression per horizon hour."""
    windows = v.windows(spark, folder)
    predicted = m.ar_mimo(windows, windows, "value", lags=1, ridge=0.0)
    hours = v.stack_hours(predicted, ["series", "anchor"], ["predicted"])
    return hours.withColumn("predicted", F.round("predicted", 4))


@query(
    "gated_blend",
    f"""WITH g AS (SELECT series, anchor, 1 / (1 + exp(-(avg(y) - 50) / 10)) AS g FROM {{scored}} GROUP BY 1, 2)
    SELECT s.series, s.anchor, s.hour, {r6('g.g * s.predicted + (1 - g.g) * p.value')} AS blended
    FROM {{scored}} s JOIN g USING (series, anchor) JOIN {{filled}} p ON p.series = s.series AND p.ts = s.anchor + INTERVAL (s.hour - 24) HOUR""",
)
def gated_blend(spark, folder):
    """The weekly and the daily naive forecast, mixed per window."""
    mean = F.aggregate("y", F.lit(0.0), lambda a, x: a + x) / 24
    windows = v.naive_forecast(spark, folder).withColumns(
        {
            "daily": F.transform(F.slice("past", -24, 24), lambda r: r["value"]),
            "logit": (mean - 50) / 10,
        }
    )
    hours = v.stack_hours(m.gated_blend(windows, "predicted", "daily", "logit"), ["series", "anchor"], ["blended"])
    return hours.withColumn("blended", v.r6("blended"))


def _week_and_day() -> m.LinearForecast:
    """A fitted model with known weights: 0.7 of last week's and 0.3 of yesterday's hour."""
    weights = np.zeros((168, 24))
    for hour in range(24):
        weights[hour, hour] = 0.7
        weights[144 + hour, hour] = 0.3
    return m.LinearForecast(weights, np.zeros(24))


@query(
    "score_windows",
    f"""SELECT s.series, s.anchor, s.hour, round(exp(0.7 * ln(1 + s.predicted) + 0.3 * ln(1 + p.value)) - 1, 2) + 0.0 AS predicted
    FROM {{scored}} s JOIN {{filled}} p ON p.series = s.series AND p.ts = s.anchor + INTERVAL (s.hour - 24) HOUR""",
)
def score_windows(spark, folder):
    """A model of log prices, mapped back and rounded to cents."""
    logged = F.transform(m.last_values("value", 168), signed_log)
    found = m.score_windows(v.windows(spark, folder), _week_and_day(), logged, inverse="signed_exp", rounded=True)
    return v.stack_hours(found, ["series", "anchor"], ["predicted"])


_WEIGHTS = {"click": 0.5, "error": 0.3, "purchase": 0.2}


@query(
    "mean_ablation",
    """WITH x AS (SELECT click, error, purchase, "view" AS y, avg(click) OVER () AS mc, avg(error) OVER () AS me, avg(purchase) OVER () AS mp
      FROM {wide} WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND "view" IS NOT NULL),
    s AS (SELECT sqrt(avg(pow(0.5 * click + 0.3 * error + 0.2 * purchase - y, 2))) AS base, sqrt(avg(pow(0.5 * mc + 0.3 * error + 0.2 * purchase - y, 2))) AS c,
      sqrt(avg(pow(0.5 * click + 0.3 * me + 0.2 * purchase - y, 2))) AS e, sqrt(avg(pow(0.5 * click + 0.3 * error + 0.2 * mp - y, 2))) AS p FROM x),
    f AS (SELECT base, unnest(['click', 'error', 'purchase']) AS feature, unnest([c, e, p]) AS a FROM s)
    SELECT feature, (SELECT count(*) FROM x) AS scored, (SELECT count(*) FROM {wide}) - (SELECT count(*) FROM x) AS left_out, round(base + 2.718281828e-8, 6) AS base_rmse, round(a + 2.718281828e-8, 6) AS ablated_rmse, round(a - base + 2.718281828e-8, 6) + 0.0 AS change FROM f""",
)
def mean_ablation(spark, folder):
    rows = v.wide(spark, folder).select(*_WEIGHTS, "view")
    model = m.LinearForecast(np.array(list(_WEIGHTS.values())), np.zeros(()))
    found = m.mean_ablation(rows, list(_WEIGHTS), "view", model)
    return found.select("feature", "scored", "left_out", *[v.r6(c).alias(c) for c in ("base_rmse", "ablated_rmse", "change")])
