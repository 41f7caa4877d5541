"""Splits, folds and shuffles over seven years of daily forecast origins."""

from pyspark.sql import functions as F

from tsforge.functions.ordered import EquiDepth
from tsforge.operators import splits as p
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import local, r6

S = ["series"]
VAL, TEST = 2000, 2001
_INDEX = ["series", "anchor", "split"]
_N = "CAST(floor(round(n * 0.2, 9)) AS BIGINT)"
_FAR = p.anchor_gap()

_FRACTION = f"""f AS (SELECT *, {_N} AS k FROM {{daily_ranked}}), t AS (SELECT *, n - 2 * k AS n_train FROM f)"""

_GAP_SPLIT = f"""{_FRACTION},
    te AS (SELECT series, max(sec) AS train_end FROM t WHERE rk <= n_train GROUP BY 1),
    vs AS (SELECT t.series, min(rk) AS val_start, min(rk) + any_value(k) AS val_stop FROM t JOIN te USING (series) WHERE rk > n_train AND sec >= train_end + {_FAR} GROUP BY 1),
    ve AS (SELECT t.series, max(sec) AS val_end FROM t JOIN vs USING (series) WHERE rk < val_stop GROUP BY 1),
    gap_split AS (SELECT series, anchor, window_date, CASE WHEN rk <= n_train THEN 'train' WHEN rk >= val_start AND rk < val_stop THEN 'val'
      WHEN rk >= val_stop AND sec >= val_end + {_FAR} THEN 'test' END AS split FROM t JOIN vs USING (series) JOIN ve USING (series))"""

_CALENDAR = f"""y AS (SELECT series, anchor, window_date, epoch(anchor)::BIGINT AS sec, year({local('window_date')}) AS y FROM {{daily_windows}}),
    te AS (SELECT series, max(sec) AS train_end FROM y WHERE y < {VAL} GROUP BY 1),
    val AS (SELECT y.* FROM y JOIN te USING (series) WHERE y = {VAL} AND sec >= train_end + {_FAR}),
    ve AS (SELECT series, max(sec) AS val_end FROM val GROUP BY 1),
    cal AS (SELECT series, anchor, window_date, 'train' AS split FROM y WHERE y < {VAL}
      UNION ALL SELECT series, anchor, window_date, 'val' FROM val
      UNION ALL SELECT y.series, y.anchor, y.window_date, 'test' FROM y JOIN ve USING (series) WHERE y = {TEST} AND sec >= val_end + {_FAR})"""


def calendar(spark, folder):
    return p.split_calendar(v.daily_windows(spark, folder), S, val_year=VAL, test_year=TEST)


@query(
    "split_fraction_rows",
    f"""WITH {_FRACTION} SELECT series, ts, split FROM (SELECT series, anchor AS ts, CASE WHEN rk <= n_train THEN 'train'
      WHEN rk > n_train + 97 AND rk <= n_train + k THEN 'val' WHEN rk > n_train + k + 97 THEN 'test' END AS split FROM t) WHERE split IS NOT NULL""",
)
def split_fraction_rows(spark, folder):
    return p.split_fraction_rows(v.daily(spark, folder), S, "ts").select("series", "ts", "split")


@query(
    "split_dense_rows",
    """WITH r AS (SELECT o_orderkey, o_orderpriority AS series, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rk,
      count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), t AS (SELECT *, CAST(floor(round(n * 0.2, 9)) AS BIGINT) AS k FROM r)
    SELECT o_orderkey, series, split FROM (SELECT *, CASE WHEN rk <= n - 2 * k THEN 'train' WHEN rk > n - 2 * k + 97 AND rk <= n - k THEN 'val'
      WHEN rk > n - k + 97 THEN 'test' END AS split FROM t) WHERE split IS NOT NULL""",
)
def split_dense_rows(spark, folder):
    """Every order by its day, many a day, in buckets of at most some fifty rows."""
    rows = v.table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series"), "o_orderdate")
    cut = p.split_fraction_rows(rows, S, "o_orderdate", ties=["o_orderkey"], width=EquiDepth(rows=50))
    return cut.select("o_orderkey", "series", "split")


@query("split_fraction_gap", f"WITH {_GAP_SPLIT} SELECT series, anchor, split FROM gap_split WHERE split IS NOT NULL")
def split_fraction_gap(spark, folder):
    return p.split_fraction_gap(v.daily_windows(spark, folder), S).select(*_INDEX)


@query("split_calendar", f"WITH {_CALENDAR} SELECT series, anchor, split FROM cal")
def split_calendar(spark, folder):
    return calendar(spark, folder).select(*_INDEX)


_FOLDS = f"""f AS (SELECT *, n - {_N} AS n_rest, {_N} AS n_test FROM {{daily_ranked}}),
    b AS (SELECT f.*, i, i * (n_rest // 5) AS size FROM f, (SELECT unnest(range(1, 6)) AS i)),
    c AS (SELECT *, size - CAST(floor(round(size * 0.2, 9)) AS BIGINT) AS n_train FROM b),
    e AS (SELECT series, i, max(sec) AS train_end FROM c WHERE rk <= n_train GROUP BY 1, 2),
    o AS (SELECT series, max(sec) AS rest_end FROM f WHERE rk <= n_rest GROUP BY 1),
    ts AS (SELECT f.series, min(rk) AS test_start FROM f JOIN o USING (series) WHERE rk > n_rest AND sec >= rest_end + {_FAR} GROUP BY 1),
    folds AS (SELECT c.series, anchor, c.i::INTEGER AS fold, CASE WHEN rk <= n_train THEN 'train' WHEN rk <= size AND sec >= train_end + {_FAR} THEN 'val' END AS split
      FROM c JOIN e ON e.series = c.series AND e.i = c.i
      UNION ALL SELECT f.series, anchor, 0, 'test' FROM f JOIN ts USING (series) WHERE rk >= test_start AND rk < test_start + n_test)"""


@query("folds_expanding", f"WITH {_FOLDS} SELECT series, anchor, fold, split FROM folds WHERE split IS NOT NULL")
def folds_expanding(spark, folder):
    return p.folds_expanding(v.daily_windows(spark, folder), S).select("series", "anchor", "fold", "split")


@query(
    "full_set",
    f"""SELECT split, feature, {r6('m')} AS mean, {r6('s')} AS scale FROM (
      SELECT 'train' AS split, 'value' AS feature, avg(value) AS m, stddev_pop(value) AS s FROM {{past_hours}})""",
)
def full_set(spark, folder):
    """All windows in one set, and the scaler fitted on it."""
    from tsforge.operators.scaling import standard_fit_windows

    whole = p.full_set(v.windows(spark, folder))
    fitted = standard_fit_windows(whole, "past", ["value"], keys=["split"])
    return fitted.withColumns({c: v.r6(c) for c in ("mean", "scale")})


_DRAWN = "('0x' || substr(md5('7|' || series || '|' || epoch(anchor)::BIGINT::VARCHAR), 1, 15))::BIGINT"


def _drawn(spark, folder):
    """The calendar split with a draw for each window that SQL can repeat."""
    rows = calendar(spark, folder).withColumns({"was": F.col("split"), "_sec": F.unix_seconds("anchor")})
    return rows, p.md5_draw(["series", "_sec"], seed=7)


@query(
    "shuffle_across",
    f"""WITH {_CALENDAR}, n AS (SELECT split, count(*) AS n, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS o FROM cal GROUP BY 1),
    s AS (SELECT split, sum(n) OVER (ORDER BY o) AS stop FROM n),
    d AS (SELECT series, anchor, split AS was, row_number() OVER (ORDER BY {_DRAWN}) AS position FROM cal)
    SELECT series, anchor, was, position, (SELECT arg_min(split, stop) FROM s WHERE stop >= position) AS split FROM d""",
)
def shuffle_across(spark, folder):
    """Every window with its old split, its place in the permutation and its new split."""
    rows, draw = _drawn(spark, folder)
    after = p.shuffle_across(rows, ["series", "anchor"], seed=7, draw=draw)
    return after.select("series", "anchor", "was", F.col("position").cast("long").alias("position"), "split")


@query(
    "shuffle_within",
    f"""WITH {_CALENDAR} SELECT series, anchor, split AS was, split, row_number() OVER (PARTITION BY split ORDER BY {_DRAWN}) AS position FROM cal""",
)
def shuffle_within(spark, folder):
    rows, draw = _drawn(spark, folder)
    after = p.shuffle_within(rows, ["series", "anchor"], seed=7, draw=draw)
    return after.select("series", "anchor", "was", "split", F.col("position").cast("long").alias("position"))


@query(
    "random_split",
    """SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('0|' || o_orderkey::VARCHAR), 1, 15))::BIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM orders""",
)
def random_split(spark, folder):
    """The side of every order; about 80 % of them are in train."""
    orders = v.table(spark, folder, "orders").select("o_orderkey")
    return p.random_split(orders, ["o_orderkey"], draw=p.md5_draw(["o_orderkey"]))


@query(
    "kfold",
    """SELECT series, anchor, (CASE WHEN rk - 1 < (n % 5) * (n // 5 + 1) THEN (rk - 1) // (n // 5 + 1)
      ELSE n % 5 + (rk - 1 - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END)::INTEGER AS fold FROM {daily_ranked}""",
)
def kfold(spark, folder):
    return p.kfold(v.daily_windows(spark, folder), S, "anchor").select("series", "anchor", "fold")


@query(
    "split_report",
    f"""WITH {_GAP_SPLIT} SELECT series, split, count(*) AS windows, min(window_date) AS first_date, max(window_date) AS last_date,
      min(year({local('window_date')}))::INTEGER AS first_year, max(year({local('window_date')}))::INTEGER AS last_year,
      (min(epoch(anchor)) - 604800)::BIGINT AS first_past, (max(epoch(anchor)) + 82800)::BIGINT AS last_future
    FROM gap_split WHERE split IS NOT NULL GROUP BY 1, 2""",
)
def split_report(spark, folder):
    cut = p.split_fraction_gap(v.daily_windows(spark, folder), S)
    return p.split_report(cut, ["series", "split"])
