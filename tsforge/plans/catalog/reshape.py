"""Resampling, pivots and unpivots."""

from pyspark.sql import functions as F

from tsforge.constants import ENTITY_CODES
from tsforge.functions.columns import map_codes
from tsforge.operators import reshape as r
from tsforge.plans import views as v
from tsforge.plans.catalog.base import query
from tsforge.plans.catalog.columns import _AGGS, _KINDS, _RAW, raw_generation
from tsforge.plans.sqlviews import r6


def _rounded(df, keys):
    return df.select(*keys, *[v.r6(c).alias(c) for c in df.columns if c not in keys])


@query("resample_mean", f"SELECT series, ts, {r6('value')} AS value FROM {{hourly}}")
def resample_mean(spark, folder):
    return _rounded(v.hourly(spark, folder), ["series", "ts"])


@query("resample_grid", f"SELECT series, ts, {r6('value')} AS value FROM {{gridded}}")
def resample_grid(spark, folder):
    return _rounded(v.gridded(spark, folder), ["series", "ts"])


_LABELS = [kind if agg is None else f"{kind}|{agg}" for kind in _KINDS for agg in _AGGS]


@query(
    "unpivot_types",
    f"""WITH {_RAW}, h AS (SELECT date_trunc('hour', ts) AS ts, type, aggregation, avg(value) AS value FROM raw GROUP BY 1, 2, 3),
    r AS (SELECT ts, value, CASE WHEN aggregation IS NULL THEN trim(split_part(type, ' [', 1))
        WHEN type = 'Hydro Pumped Storage' THEN CASE aggregation WHEN 'Actual Aggregated' THEN 'Hydro Pumped Storage_Generation' ELSE 'Hydro Pumped Storage_Consumption' END
        WHEN aggregation = 'Actual Aggregated' THEN type END AS generation_type FROM h)
    SELECT ts, generation_type, {r6('value')} AS value FROM r WHERE generation_type IN
      ('Hydro Pumped Storage_Generation', 'Hydro Pumped Storage_Consumption', 'Solar', 'Nuclear', 'Wind Onshore')""",
)
def unpivot_types(spark, folder):
    """A wide frame of all ``type|aggregation`` columns, as a feed delivers it, made long; the router
    drops what is not listed."""
    raw = raw_generation(spark, folder)
    label = F.when(F.col("aggregation").isNull(), F.col("type")).otherwise(F.concat_ws("|", "type", "aggregation"))
    hourly = raw.withColumn("label", label).groupBy(F.date_trunc("hour", "ts").alias("ts"))
    wide = hourly.pivot("label", _LABELS).agg(F.avg("value"))
    return _rounded(r.unpivot_generation(wide, ["ts"], _LABELS), ["ts", "generation_type"])


@query(
    "pivot_type_mean",
    f"""SELECT l_shipdate, l_linestatus, {r6("avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A')")} AS "A",
      {r6("avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N')")} AS "N",
      {r6("avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R')")} AS "R" FROM lineitem GROUP BY 1, 2""",
)
def pivot_type_mean(spark, folder):
    items = v.table(spark, folder, "lineitem")
    wide = r.pivot_type_mean(items, ["l_shipdate", "l_linestatus"], "l_returnflag", ["A", "N", "R"], "l_extendedprice")
    return _rounded(wide, ["l_shipdate", "l_linestatus"])


_ENTITY = ", ".join(
    f"""{r6(f"avg({m}) FILTER (WHERE l_returnflag = '{f}')")} AS "{f}_{m}" """
    for f in "ANR"
    for m in ("l_quantity", "l_extendedprice")
)


@query("pivot_entity", f"SELECT l_shipdate, {_ENTITY} FROM lineitem GROUP BY 1")
def pivot_entity(spark, folder):
    items = v.table(spark, folder, "lineitem")
    wide = r.pivot_entity(items, ["l_shipdate"], "l_returnflag", ["A", "N", "R"], ["l_quantity", "l_extendedprice"])
    return _rounded(wide, ["l_shipdate"])


_PAIRS = ", ".join(
    f"""arg_max(flow, ("timestamp", flow)) FILTER (WHERE a.code = '{a}' AND b.code = '{b}') AS "{a}_{b}_flow" """ for a, b in v.PAIRS
)


@query(
    "pivot_pairs",
    f"""SELECT date_trunc('hour', "timestamp") AS ts, {_PAIRS} FROM {{flows}} f JOIN {{codes}} a ON f.country_from = a.name
      JOIN {{codes}} b ON f.country_to = b.name GROUP BY 1""",
)
def pivot_pairs(spark, folder):
    """Raw flow readings per hour: the last reading of a pair wins."""
    rows = map_codes(v.flows(spark, folder), "country_from", ENTITY_CODES, "a")
    rows = map_codes(rows, "country_to", ENTITY_CODES, "b").withColumn("ts", F.date_trunc("hour", "timestamp"))
    return r.pivot_pairs(rows, ["ts"], "a", "b", "flow", "timestamp", v.PAIRS)


_MIX_TYPES = ["Nuclear", "Solar", "Wind Onshore", "Fossil Gas", "Waste"]
_MIX = ", ".join(
    f"""{r6(f"avg(value) FILTER (WHERE c.code = '{c}' AND generation_type = '{t}')")} AS "{c}_{t}" """
    for c in v.CODES
    for t in ("Nuclear", "Solar", "Wind Onshore", "Fossil Gas")
)


@query(
    "pivot_generation",
    f"""SELECT date_trunc('hour', "timestamp") AS "timestamp", {_MIX} FROM {{generation}} g JOIN {{codes}} c ON g.country = c.name
      WHERE generation_type <> 'Waste' GROUP BY 1""",
)
def pivot_generation(spark, folder):
    rows = map_codes(v.generation(spark, folder), "country", ENTITY_CODES, "code", strict=True)
    rows = rows.withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    return _rounded(r.pivot_generation(rows, "timestamp", "code", v.CODES, _MIX_TYPES, ["Waste"]), ["timestamp"])
