"""Tables that change together.

A set lives below one folder. Each table's rows lie in folders of their own, written once and
never changed, and a manifest names the folder of each table. A change writes new folders
first and then appends one manifest line, a single small file that appears whole or not at all; readers
follow the line with the greatest version. So whatever fails before that line leaves every table as it was,
and folders that no line names are never read. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tsforge.session import literal_table

MANIFEST = "version BIGINT, tables MAP<STRING, STRING>"
# The table of each data type, and its entity columns.
TABLE_OF = {
    "prices": "day_ahead_prices",
    "load": "load_data",
    "generation": "generation_data",
    "wind_solar_forecast": "wind_solar_forecast",
    "crossborder_flows": "crossborder_flows",
}
LOG = "download_log"
ENDS = {"crossborder_flows": ("country_from", "country_to")}


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Version and folder of each table (driver-sized: one entry a table)."""
    line = spark.read.schema(MANIFEST).json(f"{root}/manifest").orderBy(F.desc("version")).first()
    return line["version"], dict(line["tables"])


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current(spark, root)[1][name]}")


def _publish(spark: SparkSession, root: str, version: int, tables: Mapping[str, str]) -> None:
    pairs = F.map_from_arrays(*[F.array(*map(F.lit, part)) for part in zip(*sorted(tables.items()))])
    line = spark.range(1).select(F.lit(version).cast("long").alias("version"), pairs.alias("tables"))
    line.write.mode("append").json(f"{root}/manifest")


def _folder(name: str, version: int) -> str:
    return f"{name}/v{version}-{uuid.uuid4().hex}"


def create(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], partitions: Sequence[str] = ()) -> None:
    """Write the first version of a set."""
    places = {name: _folder(name, 1) for name in tables}
    for name, df in tables.items():
        df.write.partitionBy(*[c for c in partitions if c in df.columns]).parquet(f"{root}/{places[name]}")
    _publish(spark, root, 1, places)


def _hit(name: str, entity: str | None, data_type: str | None):
    """Rows of a table that a delete removes; None for all of them."""
    if name == LOG:
        tests = [F.col(c).eqNullSafe(F.lit(x)) for c, x in (("country", entity), ("data_type", data_type)) if x is not None]
        return reduce(lambda a, b: a & b, tests) if tests else None
    if entity is None:
        return None
    return reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(entity) for c in ENDS.get(name, ("country",))])


def delete(
    spark: SparkSession, root: str, entity: str | None = None, data_type: str | None = None, partitions: Sequence[str] = ()
) -> DataFrame:
    """Delete an entity's rows (all rows for None) from the table of a data type (all tables for None), and the log
    rows with them. Returns ``(table, deleted, kept)``, observed while the new folders are written.

    Flows lose the rows in which the entity is at either end. The log loses the rows of the entity and data type.
    """
    if data_type is not None and data_type not in TABLE_OF:
        raise ValueError(f"data_type must be one of {sorted(TABLE_OF)}")
    version, places = current(spark, root)
    names = [*(TABLE_OF.values() if data_type is None else [TABLE_OF[data_type]]), LOG]
    counts, staged = [], dict(places)
    for name in names:
        staged[name] = _folder(name, version + 1)
        rows, hit = spark.read.parquet(f"{root}/{places[name]}"), _hit(name, entity, data_type)
        if hit is None:  # nothing passes such a filter, so there is nothing to observe either
            counts.append((name, rows.count(), 0))
            rows.where("false").write.parquet(f"{root}/{staged[name]}")
            continue
        seen = Observation(f"delete_{name}")
        left = rows.observe(seen, F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("kept")).where(~hit)
        left.write.partitionBy(*[c for c in partitions if c in rows.columns]).parquet(f"{root}/{staged[name]}")
        counts.append((name, seen.get["deleted"], seen.get["kept"]))
    _publish(spark, root, version + 1, staged)
    return literal_table(spark, counts, "table STRING, deleted BIGINT, kept BIGINT")
