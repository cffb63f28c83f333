"""Streams over folders of Parquet: new rows by key, revisions, clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.mirror import Mirror


def file_stream(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """A stream of the rows of a Parquet table (a folder of parts, or one file), its schema read from what is there."""
    schema = spark.read.parquet(path).schema
    # As a pattern that only the path itself fits: a stream takes a single file no other way.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(f"{path[:-1]}[{path[-1]}]")


def keep_newest(stream: DataFrame, folder: str, keys: Sequence[str], version: str, columns: Sequence[str]) -> DataFrame:
    """Run what the stream has now into a keyed table and read it: one row per key, that of the greatest ``version``.

    Each micro-batch is an upsert, so a batch that is run twice, a row that comes twice and a
    revision that comes late do no harm: an older version never replaces a newer one. Ties of
    version take the greatest remaining values. Rows with a NULL key or version are left out.
    """
    table = Mirror(stream.sparkSession, f"{folder}/table")

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.select(*keys, version, *columns).where(F.col(version).isNotNull())
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        both = rows.unionByName(table.read()) if table.version() else rows
        newest = F.max(F.struct(version, *columns)).alias("r")
        table.write(both.groupBy(*keys).agg(newest).select(*keys, "r.*"))

    run = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read()


def last_seen(stream: DataFrame, folder: str, key: str, at: str) -> DataFrame:
    """Run a stream of signals into ``key, at``: the last signal of each key, kept by the stream's own state.

    Any signal resets the clock, a late one never sets it back. The state of a key is one time.
    """
    table = Mirror(stream.sparkSession, f"{folder}/table")

    def batch(rows: DataFrame, _: int) -> None:
        both = rows.unionByName(table.read()) if table.version() else rows
        table.write(both.groupBy(key).agg(F.max(at).alias(at)))

    latest = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key).agg(F.max(at).alias(at))
    run = latest.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read()


def clock_state(at: Column, as_of: Column, dormant: int = 180, inactive: int = 730) -> Column:
    """``active``, ``dormant`` after so many days without a signal, ``inactive`` after more or without any; exactly as many is not yet after."""
    quiet = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    day = 86_400_000_000
    return F.when(at.isNull() | (quiet > inactive * day), "inactive").when(quiet > dormant * day, "dormant").otherwise("active")
