"""The views of ``views`` in DuckDB SQL, as named fragments that bring their inputs along."""

from __future__ import annotations

import re

PARIS_DAY = (
    "timezone('UTC', timezone('Europe/Paris', date_trunc('day', timezone('Europe/Paris', timezone('UTC', {0})))))"
)


def local(ts: str) -> str:
    """Wall clock of the market zone for a UTC stamp."""
    return f"timezone('Europe/Paris', timezone('UTC', {ts}))"


def local_midnight(ts: str) -> str:
    return PARIS_DAY.format(ts)


def r6(x: str) -> str:
    """Rounded to 6 places. The shift is far below the last place and far above float noise:
    it moves exact ties, which engines round differently, and negative zero off the edge."""
    return f"round({x} + 2.718281828e-8, 6)"


_WIDE = ", ".join(f"max(value) FILTER (WHERE series = '{t}') AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view"))

VIEWS = {
    "hourly": "SELECT event_type AS series, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2",
    "hourly_all": "SELECT 'ALL' AS series, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2",
    "grid": (
        "SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM "
        "(SELECT series, min(ts) AS lo, max(ts) AS hi FROM {hourly} GROUP BY 1)"
    ),
    "gridded": "SELECT g.series, g.ts, h.value FROM {grid} g LEFT JOIN {hourly} h ON g.series = h.series AND g.ts = h.ts",
    "filled": (
        "SELECT series, ts, coalesce("
        "last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        "first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        ") AS value FROM {gridded}"
    ),
    "wide": "SELECT ts, " + _WIDE + " FROM {filled} GROUP BY ts",
    "market": """SELECT ts,
        CASE WHEN h % 37 <> 0 THEN "view" END AS "FR_price",
        CASE WHEN h % 41 <> 0 THEN purchase END AS "DE_price",
        CASE WHEN h % 43 <> 0 THEN click END AS "FR_Load_forecast",
        CASE WHEN h % 19 <> 0 AND h % 95 <> 1 THEN error END AS "FR_Solar_forecast",
        CASE WHEN h % 23 <> 0 THEN signup END AS "FR_Wind_Onshore_forecast",
        CASE WHEN h % 5 = 0 THEN signup / 2 END AS "FR_Wind_Offshore_forecast",
        CASE WHEN h % 47 <> 0 THEN error - signup END AS "FR_DE_flow"
        FROM (SELECT *, epoch(ts)::BIGINT // 3600 AS h FROM {wide})""",
    "daily": (
        "SELECT o_orderpriority AS series, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS value "
        "FROM orders GROUP BY 1, 2"
    ),
    "month_prices": (
        "SELECT strftime(l_shipdate, '%Y-%m') AS \"Month\", avg(l_quantity) AS \"EUA_EUR\", avg(l_discount) AS \"TTF_EUR\", "
        "avg(l_tax) AS \"ARA_EUR\" FROM lineitem GROUP BY 1"
    ),
    "prices": """SELECT ts AS "timestamp",
        (['France', 'Germany', 'Germany_Luxembourg', 'Spain', 'Italy_North'])[user_id % 5 + 1] AS country,
        value AS price, 'EUR/MWh' AS unit FROM events WHERE event_type = 'view'""",
    "load": """SELECT ts AS "timestamp", (['France', 'Germany', 'Spain', 'Italy'])[user_id % 4 + 1] AS country,
        CASE WHEN event_id % 3 <> 0 THEN value END AS actual_load, value * 1.1 AS forecast_load, 'MW' AS unit
        FROM events WHERE event_type = 'click'""",
    "wind_solar": """SELECT ts AS "timestamp", (['France', 'Germany', 'Spain', 'Italy'])[user_id % 4 + 1] AS country,
        (['Solar', 'Wind Onshore', 'Wind Offshore'])[(user_id // 4) % 3 + 1] AS forecast_type, value, 'MW' AS unit
        FROM events WHERE event_type = 'purchase'""",
    "generation": """SELECT ts AS "timestamp", (['France', 'Germany', 'Spain', 'Italy'])[user_id % 4 + 1] AS country,
        (['Nuclear', 'Solar', 'Wind Onshore', 'Fossil Gas', 'Waste'])[event_id % 5 + 1] AS generation_type,
        value, 'MW' AS unit FROM events""",
    "flows": """SELECT "timestamp", CASE WHEN outgoing THEN 'France' ELSE other END AS country_from,
        CASE WHEN outgoing THEN other ELSE 'France' END AS country_to, flow, 'MW' AS unit
        FROM (SELECT ts AS "timestamp", user_id % 2 = 0 AS outgoing, value AS flow,
              (['Germany', 'Germany_Luxembourg', 'Spain', 'Italy', 'Atlantis'])[(user_id // 2) % 5 + 1] AS other
              FROM events WHERE event_type IN ('error', 'signup'))""",
    "codes": """SELECT * FROM (VALUES ('France', 'FR'), ('Germany', 'DE'), ('Germany_Luxembourg', 'DE'),
        ('Germany_Austria_Luxembourg', 'DE'), ('Italy', 'IT'), ('Italy_North', 'IT'), ('Spain', 'ES'),
        ('Great Britain', 'GB'), ('Netherlands', 'NL'), ('Belgium', 'BE'), ('Switzerland', 'CH'), ('Austria', 'AT')) AS t(name, code)""",
    "cells": """SELECT date_trunc('hour', p."timestamp") AS ts, c.code || '_price' AS col, avg(price) AS v
          FROM {prices} p JOIN {codes} c ON p.country = c.name GROUP BY 1, 2
        UNION ALL SELECT date_trunc('hour', p."timestamp"), c.code || '_Load_forecast', avg(forecast_load)
          FROM {load} p JOIN {codes} c ON p.country = c.name GROUP BY 1, 2
        UNION ALL SELECT date_trunc('hour', p."timestamp"), c.code || '_' || replace(forecast_type, ' ', '_') || '_forecast', avg(value)
          FROM {wind_solar} p JOIN {codes} c ON p.country = c.name GROUP BY 1, 2
        UNION ALL SELECT ts, col, arg_max(flow, name) FROM (
          SELECT date_trunc('hour', f."timestamp") AS ts, a.code || '_' || b.code || '_flow' AS col,
            country_from || chr(1) || country_to AS name, avg(flow) AS flow
          FROM {flows} f JOIN {codes} a ON f.country_from = a.name JOIN {codes} b ON f.country_to = b.name GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "trade": """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS "timestamp", b.n_name AS country_from, s.n_name AS country_to,
        sum(l_extendedprice) AS flow FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation b ON c_nationkey = b.n_nationkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2, 3""",
    "chunk_log": """SELECT o_orderpriority AS country, o_orderstatus AS data_type,
        date_trunc('quarter', o_orderdate)::TIMESTAMP AS start_date,
        (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::TIMESTAMP AS end_date,
        max(o_orderdate) AS download_timestamp, CASE WHEN count(*) % 7 = 0 THEN 'error' ELSE 'success' END AS status
        FROM orders GROUP BY 1, 2, 3, 4""",
    # Windows of the filled grid: every local day, its rows counted around the midnight.
    "anchors": f"SELECT DISTINCT series, {local_midnight('ts')} AS anchor FROM {{filled}}",
    "window_counts": """SELECT a.series, a.anchor,
        count(*) FILTER (WHERE r.ts < a.anchor) AS hist,
        count(*) FILTER (WHERE r.ts >= a.anchor AND r.ts < a.anchor + INTERVAL 24 HOUR) AS hor,
        coalesce(bool_or(r.ts = a.anchor), false) AS at_anchor,
        coalesce(bool_or(r.ts = a.anchor + INTERVAL 24 HOUR), false) AS at_end,
        count(*) FILTER (WHERE r.value IS NULL AND r.ts < a.anchor + INTERVAL 24 HOUR) AS nulls
        FROM {anchors} a JOIN {filled} r ON r.series = a.series
          AND r.ts >= a.anchor - INTERVAL 168 HOUR AND r.ts <= a.anchor + INTERVAL 24 HOUR GROUP BY 1, 2""",
    "windows": """SELECT series, anchor, anchor + INTERVAL 12 HOUR AS window_date FROM {window_counts}
        WHERE at_anchor AND at_end AND hist = 168 AND hor = 24 AND nulls = 0""",
    "scored": """SELECT w.series, w.anchor, w.window_date, (epoch(y.ts - w.anchor) / 3600)::INTEGER AS hour, y.value AS y, p.value AS predicted
        FROM {windows} w JOIN {filled} y ON y.series = w.series AND y.ts >= w.anchor AND y.ts < w.anchor + INTERVAL 24 HOUR
        JOIN {filled} p ON p.series = w.series AND p.ts = y.ts - INTERVAL 168 HOUR""",
    "past_hours": """SELECT w.series, w.anchor, r.ts, r.value FROM {windows} w JOIN {filled} r
        ON r.series = w.series AND r.ts >= w.anchor - INTERVAL 168 HOUR AND r.ts < w.anchor""",
    "daily_windows": "SELECT series, ts AS anchor, ts + INTERVAL 12 HOUR AS window_date, value FROM {daily}",
    "daily_ranked": (
        "SELECT *, row_number() OVER (PARTITION BY series ORDER BY anchor) AS rk, count(*) OVER (PARTITION BY series) AS n, "
        "epoch(anchor)::BIGINT AS sec FROM {daily_windows}"
    ),
}

_NAME = re.compile(r"\{(\w+)\}")


def _collect(text: str, seen: dict[str, str]) -> str:
    for name in _NAME.findall(text):
        if name not in seen:
            body = _collect(VIEWS[name], seen)
            seen[name] = body
    return _NAME.sub(r"\1_v", text)


def sql(text: str) -> str:
    """A query whose ``{view}`` references become common table expressions."""
    seen: dict[str, str] = {}
    body = _collect(text, seen)
    if not seen:
        return body
    parts = ", ".join(f"{name}_v AS MATERIALIZED ({view})" for name, view in seen.items())
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {parts}, {body.lstrip()[5:]}"
    return f"WITH {parts} {body}"
