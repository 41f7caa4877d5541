"""Scans, sinks and the keyed upsert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tsforge.functions.columns import fixed_width
from tsforge.session import literal_table
from tsforge.sources.schemas import schema as table_schema

# --------------------------------------------------------------------- scans


def scan(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    format: str = "parquet",
    **options,
) -> DataFrame:
    """Full scan with a declared schema (a ``StructType``, DDL text or a table name).

    Reading wall-clock Parquet stamps with a ``TIMESTAMP`` schema yields instants at the
    scan itself, so time filters still reach the Parquet reader.
    """
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        known = isinstance(schema, str) and " " not in schema
        reader = reader.schema(table_schema(schema) if known else schema)
    return reader.load(path)


def scan_flows(
    df: DataFrame,
    frm: str | None = None,
    to: str | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Flows by optional end points and inclusive time bounds, in time, from, to order."""
    if frm is not None:
        df = df.where(F.col("country_from") == frm)
    if to is not None:
        df = df.where(F.col("country_to") == to)
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    return df.orderBy("timestamp", "country_from", "country_to")


def scan_csv(
    spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None
) -> DataFrame:
    """CSV with declared columns and types. Columns are found by header name whatever
    their order; a missing one is an error; a value that does not parse stops the job."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = list(columns or declared.fieldNames())
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in wanted if c not in header]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    kinds = {f.name: f.dataType for f in declared.fields}
    full = StructType()
    for name in header:
        full.add(name, kinds[name] if name in kinds and name in wanted else "string")
    return (
        spark.read.schema(full)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
        .select(*wanted)
    )


# --------------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def export_tables(tables: Mapping[str, DataFrame], out: str) -> DataFrame:
    """Write every table to Parquet; row counts are observed while writing, so nothing is
    read twice. Returns one row per table (bounded by the number of tables)."""
    stats, spark = [], None
    for name, df in tables.items():
        spark = df.sparkSession
        seen = Observation(f"export_{name}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{out}/{name}")
        stats.append((name, seen.get["rows"], len(df.columns)))
    if spark is None:
        raise ValueError("no tables to export")
    return literal_table(spark, stats, "table STRING, rows BIGINT, cols INT")


def head(df: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in key order (Spark keeps only ``n`` rows per task)."""
    return df.orderBy(*keys).limit(n)


def manifest(df: DataFrame, target: str, past: Sequence[str], future: Sequence[str]) -> DataFrame:
    """The column-role manifest as one row, ready for ``write.json``."""
    return literal_table(
        df.sparkSession,
        [(list(past), list(future), target)],
        "past_cols ARRAY<STRING>, future_cols ARRAY<STRING>, target_col STRING",
    )


def write_manifest(roles: DataFrame, path: str) -> None:
    roles.coalesce(1).write.json(path)


def read_manifest(spark: SparkSession, path: str):
    """The one manifest row (driver-sized by construction)."""
    row = spark.read.schema(
        "past_cols ARRAY<STRING>, future_cols ARRAY<STRING>, target_col STRING"
    ).json(path)
    return row.first()


def write_windows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Windows partitioned by split and, where present, fold."""
    df.write.mode(mode).partitionBy(*[c for c in ("split", "fold") if c in df.columns]).parquet(path)


# ------------------------------------------------------------------- upserts


def _latest(keys: Sequence[str], columns: Sequence[str], order: Sequence[Column | str]) -> list[Column]:
    rest = [c for c in columns if c not in keys]
    newest = F.max(F.struct(*order, *[F.col(c).alias(f"v_{c}") for c in rest]))
    return [newest.alias("_newest")]


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], ingest: str | None = None) -> DataFrame:
    """Union of ``target`` and ``batch`` with one row per key: the one with the greatest
    ``ingest`` column, or the batch's when there is none. Equal candidates are settled by
    their values, so a replayed batch changes nothing. Combines before it shuffles."""
    columns = target.columns
    both = target.select(*columns, F.lit(0).alias("_from_batch")).unionByName(
        batch.select(*columns, F.lit(1).alias("_from_batch"))
    )
    rest = [c for c in columns if c not in keys]
    if ingest is None and len(rest) == 1 and fixed_width(target, rest):
        # One value of a side is its greatest, and the batch's side wins where it has the key: no struct to sort.
        (one,) = rest
        side = [F.max(F.when(F.col("_from_batch") == k, F.col(one))) for k in (0, 1)]
        value = F.when(F.max("_from_batch") == 1, side[1]).otherwise(side[0])
        return both.groupBy(*keys).agg(value.alias(one)).select(*columns)
    order = [F.col(ingest).alias("_order")] if ingest else [F.col("_from_batch").alias("_order")]
    merged = both.groupBy(*keys).agg(*_latest(keys, columns, order))
    return merged.select(*[F.col(c) if c in keys else F.col(f"_newest.v_{c}").alias(c) for c in columns])


def upsert_table(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    keys: Sequence[str],
    partitions: Sequence[str],
    ingest: str | None = None,
) -> None:
    """Upsert into a partitioned Parquet table, rewriting only the touched partitions.

    Rows are staged and moved when the job commits, so a failed run leaves the old files;
    running the same batch again gives the same table. One writer at a time.
    """
    schema = batch.schema
    try:
        current = spark.read.schema(schema).parquet(path)
    except Exception as missing:  # first load: the folder is not there yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        merged = upsert(batch.where("false"), batch, keys, ingest)
    else:
        touched = batch.select(*partitions).distinct()
        merged = upsert(current.join(touched, list(partitions), "left_semi").select(*batch.columns), batch, keys, ingest)
    (
        # Rows of a partition go together, a partition that is too big for one task is split.
        merged.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def roles_from(df: DataFrame, target: str, past: Sequence[str], future: Sequence[str]) -> DataFrame:
    """Long form of the manifest with how many known values each column has: one pass,
    one count per column, ``(role, position, column, known)``."""
    used = list(dict.fromkeys([*past, *future, target]))
    counts = df.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in used])
    known = counts.unpivot([], used, "column", "known")
    roles = [("past", i, c) for i, c in enumerate(past)]
    roles += [("future", i, c) for i, c in enumerate(future)]
    roles += [("target", 0, target)]
    listed = literal_table(df.sparkSession, roles, "role STRING, position INT, column STRING")
    return listed.join(known, "column").select("role", "position", "column", "known")

