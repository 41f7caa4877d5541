"""Loads as they arrive: hourly means, key de-duplication and resumable ingestion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from tsforge.sources.io import upsert_table

LATENESS = "2 hours"


def read_files(
    spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet", per_batch: int | None = None
) -> DataFrame:
    """A stream of the files that land in a folder, each read once per checkpoint."""
    reader = spark.readStream.format(format).schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path)


def stream_resample(
    df: DataFrame, series: Sequence[str], ts: str, value: str = "value", lateness: str = LATENESS
) -> DataFrame:
    """Hourly mean per series; hours close ``lateness`` behind the newest reading. State
    holds a sum and a count per open hour."""
    return (
        df.withWatermark(ts, lateness)
        .groupBy(*series, F.window(ts, "1 hour").alias("_w"))
        .agg(F.avg(value).alias(value))
        .select(*series, F.col("_w.start").alias(ts), value)
    )


def stream_dedupe(df: DataFrame, keys: Sequence[str], ts: str, lateness: str = LATENESS) -> DataFrame:
    """One row per key, the first to arrive; keys are forgotten behind the watermark."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def stream_first(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], lateness: str = LATENESS
) -> DataFrame:
    """The least row of each key by ``order`` (numbers), whatever the order of arrival, with ``revision``.

    A key's first row comes out with revision 0; a lesser one that arrives later comes out as a correction with the
    next revision, so of a key the row with the greatest revision counts. State holds the order and revision
    of a key until its newest row is ``lateness`` behind the watermark; rows behind the watermark are dropped.
    Rows of a key meet inside their batch first, so a hot key sends a task few rows.
    """
    names, by = list(keys), list(order)
    seconds = int(pd.Timedelta(lateness).total_seconds())

    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            newest = frame.groupby(names, dropna=False, sort=False)[ts].transform("max")
            best = frame.assign(_newest=newest).sort_values(by, kind="stable").drop_duplicates(names)
            yield best

    def keep(_key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *held, revision, newest = state.get if state.exists else (*[math.inf] * len(by), -1, 0)
        best = None
        for frame in frames:
            newest = max(newest, int(frame["_newest"].max().timestamp() * 1000))
            row = frame.sort_values(by, kind="stable").iloc[:1]
            mine = [float(row[c].iloc[0]) for c in by]
            if mine < held:
                best, held = row, mine
        revision += best is not None
        state.update((*held, int(revision), newest))
        state.setTimeoutTimestamp(max(newest + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        if best is not None:
            yield best.drop(columns="_newest").assign(revision=int(revision))

    columns = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]
    reduced = df.mapInPandas(least, ", ".join([*columns, "_newest timestamp"]))
    return (
        reduced.withWatermark(ts, lateness)
        .groupBy(*names)
        .applyInPandasWithState(
            keep,
            ", ".join([*columns, "revision INT"]),
            ", ".join([*[f"{c} DOUBLE" for c in by], "revision INT", "newest BIGINT"]),
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def run_available(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append", format: str = "parquet"
) -> StreamingQuery:
    """Process what is there, write it to files and stop. Resumes from ``checkpoint``."""
    query = (
        df.writeStream.format(format)
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_ingest(
    df: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    partitions: Sequence[str],
    ingest: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Upsert each new file into a partitioned table exactly once per key: a batch that is
    run again after a failure merges to the same rows."""

    def load(batch: DataFrame, _number: int) -> None:
        ready = prepare(batch) if prepare else batch
        upsert_table(batch.sparkSession, path, ready, keys, partitions, ingest)

    query = (
        df.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
