"""History/horizon windows."""

from pyspark.sql import functions as F

from tsforge.functions.columns import cyclical, parse_dmy
from tsforge.operators import windows as w
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.sqlviews import local_midnight, r6

S = ["series"]


@query(
    "delta_stats",
    f"""WITH d AS (SELECT series, epoch(ts - lag(ts) OVER (PARTITION BY series ORDER BY ts))::BIGINT AS delta FROM {{hourly}})
    SELECT series, {r6('avg(delta)')} AS mean_delta, min(delta) AS min_delta, max(delta) AS max_delta,
      count(DISTINCT delta) AS distinct_deltas FROM d WHERE delta IS NOT NULL GROUP BY 1""",
)
def delta_stats(spark, folder):
    return w.delta_stats(v.hourly(spark, folder), S, "ts").withColumn("mean_delta", v.r6("mean_delta"))


_SEGMENTS = """j AS (SELECT series, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY series ORDER BY ts) > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS jump FROM {%s}),
    g AS (SELECT series, ts, sum(jump) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM j),
    segs AS (SELECT series, seg::BIGINT AS seg, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM g GROUP BY 1, 2)"""


@query(
    "segments",
    f"""WITH {_SEGMENTS % 'hourly'} SELECT series, seg, lo AS "start", hi AS "end", n FROM segs""",
)
def segments(spark, folder):
    return w.segments(v.hourly(spark, folder), S, "ts")


@query(
    "day_anchors",
    f"""WITH {_SEGMENTS % 'filled'}, a AS (
      SELECT DISTINCT s.series, s.seg, {local_midnight('g.ts')} AS anchor, s.lo, s.hi FROM segs s JOIN g ON g.series = s.series AND g.seg = s.seg WHERE s.n >= 192)
    SELECT series, seg, anchor FROM a WHERE anchor >= lo + INTERVAL 168 HOUR AND anchor <= hi - INTERVAL 24 HOUR""",
)
def day_anchors(spark, folder):
    return w.day_anchors(v.filled(spark, folder), S, "ts")


@query(
    "make_windows",
    f"""WITH p AS (SELECT series, anchor, count(*) AS past_hours, min(ts) AS first_past, max(ts) AS last_past, sum(value) AS past_sum FROM {{past_hours}} GROUP BY 1, 2),
    y AS (SELECT series, anchor, window_date, count(*) AS target_hours, sum(y) AS target_sum, sum(y * hour) AS weighted,
      sum(sin(2 * pi() * (epoch(anchor) + hour * 3600) / 86400)) AS calendar FROM {{scored}} GROUP BY 1, 2, 3)
    SELECT series, anchor, window_date, past_hours::INTEGER AS past_hours, first_past, last_past, {r6('past_sum')} AS past_sum,
      target_hours::INTEGER AS target_hours, {r6('target_sum')} AS target_sum, {r6('weighted')} AS weighted, {r6('calendar')} AS calendar
    FROM p JOIN y USING (series, anchor)""",
)
def make_windows(spark, folder):
    """Every window, each described by what it holds and in which order."""

    def total(array, value):
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + value(x))

    steps = F.arrays_zip(F.col("y").alias("y"), F.sequence(F.lit(0), F.lit(23)).alias("h"))
    return v.windows(spark, folder).select(
        "series",
        "anchor",
        "window_date",
        F.size("past").alias("past_hours"),
        F.col("past")[0]["ts"].alias("first_past"),
        F.element_at("past", -1)["ts"].alias("last_past"),
        v.r6(total("past", lambda r: r["value"])).alias("past_sum"),
        F.size("y").alias("target_hours"),
        v.r6(total("y", lambda x: x)).alias("target_sum"),
        v.r6(total(steps, lambda z: z["y"] * z["h"])).alias("weighted"),
        v.r6(total("future", lambda r: r["Day_sin"])).alias("calendar"),
    )


def _statuses(view: str) -> str:
    return f"""SELECT '{view}' AS source, series, status, count(*) AS windows FROM (
      SELECT a.series, CASE WHEN NOT coalesce(bool_or(r.ts = a.anchor), false) OR NOT coalesce(bool_or(r.ts = a.anchor + INTERVAL 24 HOUR), false) THEN 'missing_stamp'
          WHEN count(*) FILTER (WHERE r.ts < a.anchor) <> 168 OR count(*) FILTER (WHERE r.ts >= a.anchor AND r.ts < a.anchor + INTERVAL 24 HOUR) <> 24 THEN 'missing_rows'
          WHEN count(*) FILTER (WHERE r.value IS NULL AND r.ts < a.anchor + INTERVAL 24 HOUR) > 0 THEN 'missing_data' ELSE 'complete' END AS status
      FROM (SELECT DISTINCT series, {local_midnight('ts')} AS anchor FROM {{{view}}}) a
      LEFT JOIN {{{view}}} r ON r.series = a.series AND r.ts >= a.anchor - INTERVAL 168 HOUR AND r.ts <= a.anchor + INTERVAL 24 HOUR
      GROUP BY a.series, a.anchor) GROUP BY 2, 3"""


@query("window_rejects", " UNION ALL ".join(_statuses(x) for x in ("hourly", "hourly_all", "gridded")))
def window_rejects(spark, folder):
    """Series with missing rows, a whole series and series with nulls on a full grid."""
    out = None
    for name in ("hourly", "hourly_all", "gridded"):
        rows = getattr(v, name)(spark, folder)
        found = w.window_candidates(rows, S, "ts", ["value"], ["value"], "value", dedupe=False)
        counted = w.window_rejects(found, S).select(F.lit(name).alias("source"), *S, "status", "windows")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "window_spacing",
    f"""WITH d AS (SELECT series, epoch(anchor - lag(anchor) OVER (PARTITION BY series ORDER BY anchor))::BIGINT AS delta FROM {{windows}})
    SELECT series, delta, count(*) AS occurrences, {r6('avg(avg(delta)) OVER (PARTITION BY series)')} AS mean_delta,
      min(delta) OVER (PARTITION BY series) AS min_delta, max(delta) OVER (PARTITION BY series) AS max_delta
    FROM d WHERE delta IS NOT NULL GROUP BY series, delta""",
)
def window_spacing(spark, folder):
    return w.window_spacing(v.windows(spark, folder), S).withColumn("mean_delta", v.r6("mean_delta"))


@query("window_date", "SELECT series, anchor, anchor + INTERVAL 12 HOUR AS window_date FROM {windows}")
def window_date(spark, folder):
    return v.windows(spark, folder).select("series", "anchor", "window_date")


@query(
    "windows_between",
    f"""SELECT series, anchor FROM {{windows}} WHERE {local_midnight('window_date')} BETWEEN {local_midnight("TIMESTAMP '2024-01-12 12:00:00'")}
      AND {local_midnight("TIMESTAMP '2024-01-20 12:00:00'")}""",
)
def windows_between(spark, folder):
    return w.windows_between(v.windows(spark, folder), "12/01/2024", "20/01/2024").select("series", "anchor")


@query(
    "request_window",
    f"""WITH req AS (SELECT DISTINCT {local_midnight('ts')} AS target_date FROM events UNION SELECT {local_midnight("TIMESTAMP '2023-06-15 12:00:00'")}),
    r AS (SELECT q.target_date, f.series, f.ts, f.value, f.ts < q.target_date AS before,
        row_number() OVER (PARTITION BY q.target_date, f.series, f.ts < q.target_date ORDER BY CASE WHEN f.ts < q.target_date THEN -epoch(f.ts) ELSE epoch(f.ts) END) AS k
      FROM req q JOIN {{filled}} f ON f.ts >= {local_midnight("q.target_date - INTERVAL 156 HOUR")} AND f.ts < {local_midnight("q.target_date + INTERVAL 36 HOUR")}),
    c AS (SELECT target_date, series, count(*) FILTER (WHERE before AND k <= 168) AS np, count(*) FILTER (WHERE NOT before AND k <= 24) AS nf,
      sum(value) FILTER (WHERE before AND k <= 168) AS sp, sum(value) FILTER (WHERE NOT before AND k <= 24) AS sf FROM r GROUP BY 1, 2)
    SELECT target_date, series, CASE WHEN series IS NULL THEN 'no_data' WHEN np < 168 THEN 'short_past' WHEN nf < 24 THEN 'short_future' ELSE 'ok' END AS status,
      coalesce(np, 0)::INTEGER AS past_hours, coalesce(nf, 0)::INTEGER AS future_hours, {r6('coalesce(sp, CASE WHEN series IS NOT NULL THEN 0 END)')} AS past_sum,
      {r6('coalesce(sf, CASE WHEN series IS NOT NULL THEN 0 END)')} AS actual_sum FROM req LEFT JOIN c USING (target_date)""",
)
def request_window(spark, folder):
    """One request per local day of the data and one for a day without any."""
    days = v.events(spark, folder).select(
        F.date_format(F.from_utc_timestamp("ts", "Europe/Paris"), "dd/MM/yyyy").alias("text")
    )
    asked = days.distinct().unionByName(spark.range(1).select(F.lit("15/06/2023").alias("text")))
    requests = asked.select(parse_dmy("text").alias("target_date"))
    found = w.request_windows(requests, cyclical(v.filled(spark, folder)), S, "ts", ["value"], ["Day_sin"], "value")
    return found.select(
        "target_date",
        "series",
        "status",
        F.coalesce(F.array_size("past"), F.lit(0)).alias("past_hours"),
        F.coalesce(F.array_size("future"), F.lit(0)).alias("future_hours"),
        v.r6(F.aggregate("past", F.lit(0.0), lambda a, r: a + r["value"])).alias("past_sum"),
        v.r6(F.aggregate("actual", F.lit(0.0), lambda a, x: a + x)).alias("actual_sum"),
    )


@query("stack_hours", f"SELECT series, anchor, hour, {r6('y')} AS y FROM {{scored}}")
def stack_hours(spark, folder):
    stacked = w.stack_hours(v.windows(spark, folder), ["series", "anchor"], ["y"])
    return stacked.withColumn("y", v.r6("y"))
