"""Error statistics of the weekly naive forecast."""

from pyspark.sql import functions as F

from tsforge.functions.columns import signed_log
from tsforge.operators import crossval
from tsforge.operators import evaluate as e
from tsforge.operators.splits import kfold as assign_folds
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import r6

S = ["series"]


def _rounded(df, keys):
    return df.select(*keys, *[v.r6(c).alias(c) for c in df.columns if c not in keys])


_RMSE = "sqrt(avg((y - predicted) * (y - predicted)))"
_MAE = "avg(abs(y - predicted))"


@query("rmse_mae", f"SELECT series, {r6(_RMSE)} AS rmse, {r6(_MAE)} AS mae FROM {{scored}} GROUP BY 1")
def rmse_mae(spark, folder):
    return _rounded(e.rmse_mae(v.scored(spark, folder), by=S), S)


@query(
    "mape_safe",
    f"SELECT series, {r6('avg(abs((y - predicted) / greatest(abs(y), 1e-6))) * 100')} AS mape FROM {{scored}} GROUP BY 1",
)
def mape_safe(spark, folder):
    return _rounded(e.mape_safe(v.scored(spark, folder), by=S), S)


@query(
    "mape_raw",
    f"""SELECT series, {r6('avg(abs((y - predicted) / nullif(y, 0))) * 100')} AS mape, count(*) FILTER (WHERE y = 0) AS excluded
    FROM (SELECT series, CASE WHEN hour % 6 = 0 THEN 0 ELSE y END AS y, predicted FROM {{scored}}) GROUP BY 1""",
)
def mape_raw(spark, folder):
    rows = v.scored(spark, folder).withColumn("y", F.when(F.col("hour") % 6 == 0, 0.0).otherwise(F.col("y")))
    return _rounded(e.mape_raw(rows, by=S), ["series", "excluded"])


@query(
    "hourly_profile",
    f"""WITH p AS (SELECT series, hour, avg(y) AS y, avg(predicted) AS predicted FROM {{scored}} GROUP BY 1, 2),
    t AS (SELECT series, {_RMSE} AS rmse, {_MAE} AS mae FROM p GROUP BY 1)
    SELECT series, hour, {r6('y')} AS y, {r6('predicted')} AS predicted, {r6('rmse')} AS profile_rmse, {r6('mae')} AS profile_mae FROM p JOIN t USING (series)""",
)
def hourly_profile(spark, folder):
    profile = e.hourly_profile(v.scored(spark, folder), by=S)
    errors = e.rmse_mae(profile, by=S).withColumnsRenamed({"rmse": "profile_rmse", "mae": "profile_mae"})
    return _rounded(profile.join(errors, "series"), ["series", "hour"])


@query(
    "paired_stats",
    f"""WITH a AS (SELECT series, anchor, predicted, CASE WHEN hour % 5 <> 0 AND epoch(anchor)::BIGINT // 86400 % 4 <> 0 THEN y END AS actual FROM {{scored}})
    SELECT series, anchor, {r6('avg(predicted)')} AS avg_predicted, {r6('avg(actual)')} AS avg_actual,
      {r6('sqrt(avg((predicted - actual) * (predicted - actual)))')} AS rmse, {r6('avg(abs(predicted - actual))')} AS mae
    FROM a GROUP BY 1, 2 HAVING count(actual) > 0""",
)
def paired_stats(spark, folder):
    """Every fifth actual is missing, and all of them on every fourth day."""
    known = (F.col("hour") % 5 != 0) & (F.floor(F.unix_seconds("anchor") / 86400) % 4 != 0)
    rows = v.scored(spark, folder).withColumn("actual", F.when(known, F.col("y")))
    return _rounded(e.paired_stats(rows, ["series", "anchor"]), ["series", "anchor"])


@query("max_signed_error", f"SELECT series, {r6('max(predicted - y)')} AS max_error FROM {{scored}} GROUP BY 1")
def max_signed_error(spark, folder):
    return _rounded(e.max_signed_error(v.scored(spark, folder), by=S), S)


_HOME = """r AS (SELECT {k}, {t} AS stamp, row_number() OVER (PARTITION BY {k} ORDER BY {t}) - 1 AS k, count(*) OVER (PARTITION BY {k}) AS n FROM {v}),
    f AS (SELECT {k}, stamp, CASE WHEN k < (n % 5) * (n // 5 + 1) THEN k // (n // 5 + 1) ELSE n % 5 + (k - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS home FROM r)"""


@query(
    "kfold_scores",
    f"""WITH a AS (SELECT series, anchor + INTERVAL (hour) HOUR AS ts, predicted AS x, y FROM {{scored}}), {_HOME.format(k='series', t='ts', v='a')},
    z AS (SELECT home, x, y FROM a JOIN f ON f.series = a.series AND f.stamp = a.ts),
    m AS (SELECT i, regr_slope(y, x) AS s, regr_intercept(y, x) AS c, count(*) AS n FROM z, range(5) t(i) WHERE home <> i GROUP BY 1)
    SELECT i::INTEGER AS fold, any_value(n) AS train_rows, count(*) AS "rows", {r6('avg(pow(y - s * x - c, 2))')} AS mse, {r6('avg(pow(y - s * x - c, 2))')} AS val_mse,
      {r6('avg(abs(y - s * x - c))')} AS mae FROM z JOIN m ON home = i GROUP BY 1""",
)
def kfold_scores(spark, folder):
    """Five unshuffled folds of each series' hours, the value of a week before as input, each scored by the model of the other four. The squared error comes
    twice: from the subtracted moments (``val_mse``) and from the rows."""
    ts = F.timestamp_seconds(F.unix_seconds("anchor") + 3600 * F.col("hour")).alias("ts")
    rows = v.scored(spark, folder).select("series", ts, F.array("predicted").alias("x"), F.array("y").alias("y"))
    fits, scores = crossval.cross_validate(assign_folds(rows, S, "ts"), inputs=1)
    own = scores.where("split = 'val'").join(fits.select("fold", "train_rows", "val_mse"), "fold")
    return own.select("fold", "train_rows", "rows", *[v.r6(c).alias(c) for c in ("mse", "val_mse", "mae")])


@query(
    "fold_mean",
    f"""WITH {_HOME.format(k='series', t='anchor', v='{windows}')},
    z AS (SELECT s.hour, s.y, avg(s.predicted) OVER (PARTITION BY s.series, s.anchor) AS x, home FROM {{scored}} s JOIN f ON f.series = s.series AND f.stamp = s.anchor),
    m AS (SELECT i, hour, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM z, range(5) t(i) WHERE home <> i GROUP BY 1, 2),
    e AS (SELECT i AS fold, CASE WHEN home = i THEN 'val' ELSE 'train' END AS split, y - a * x - b AS e FROM z JOIN m USING (hour)),
    s AS (SELECT fold, split, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM e GROUP BY 1, 2)
    SELECT split, {r6('avg(mse)')} AS mse, {r6('avg(rmse)')} AS rmse, {r6('avg(mae)')} AS mae FROM s GROUP BY 1""",
)
def fold_mean(spark, folder):
    """For each fold, the 24 hours of a day from the mean of the same day a week before, with scaler and model of
    the other folds; scores of both splits, averaged over the folds."""
    folded = assign_folds(v.naive_forecast(spark, folder), S, "anchor")
    mean = F.aggregate("predicted", F.lit(0.0), lambda a, x: a + x) / 24
    _, scores = crossval.cross_validate(folded.select("fold", F.array(mean).alias("x"), "y"), inputs=1, targets=24)
    return _rounded(e.fold_mean(scores), ["split"])


_LOG = "sign({0}) * ln(1 + abs({0}))"


@query(
    "dual_space_eval",
    f"""SELECT series, {r6(f"sqrt(avg(pow({_LOG.format('y')} - {_LOG.format('predicted')}, 2)))")} AS log_rmse,
      {r6(_RMSE)} AS rmse, {r6(_MAE)} AS mae FROM {{scored}} GROUP BY 1""",
)
def dual_space_eval(spark, folder):
    rows = v.scored(spark, folder).withColumns({c: signed_log(c) for c in ("y", "predicted")})
    return _rounded(e.dual_space_eval(rows, by=S), S)
