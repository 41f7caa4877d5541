"""Session settings and shared scratch storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def session(app: str = "tsforge", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library relies on.

    Only the UTC time zone is required for right results; the rest lets Spark re-plan at
    run time (coalescing small shuffle partitions, splitting skewed join partitions).
    Shuffle width is left to the caller: AQE coalesces down from whatever is set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Plans here have hundreds of columns; recording a call site for each costs seconds.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Instants are compared and truncated in UTC, whatever session we are handed."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local temporary folder is used only where the setting is absent and the
    whole session runs in one process; anywhere else its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="tsforge-")
        spark.conf.set("spark.checkpoint.dir", named)
        return named
    raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str = "cut"):
    """Write ``df`` to the shared folder and read it back: lineage ends at durable files,
    so the loss of an executor costs a re-read and not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A handful of constant rows (columns, models, draws: small by nature) as part of the plan, so that Spark
    knows their size."""
    schema = StructType.fromDDL(ddl)

    def cell(value, kind):
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(x) for x in value]).cast(kind)
        return F.lit(value).cast(kind)

    structs = [
        F.struct(*[cell(value, f.dataType).alias(f.name) for value, f in zip(row, schema.fields)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
