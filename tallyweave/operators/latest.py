"""Latest version of each keyed row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_version(df: DataFrame, keys: list[str], version: str, keep: list[str]) -> DataFrame:
    """One row per key: ``keep`` columns of the row with the greatest ``version``.

    A map-side combinable ``max`` over a struct, so repeated rows collapse before the
    shuffle. Rows with a NULL key are dropped; a NULL version sorts before any other;
    ties of version take the greatest remaining values, so the result is deterministic.
    """
    row = F.struct(F.col(version).alias("__v"), *[F.col(c) for c in keep])
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    best = df.groupBy(*keys).agg(F.max(row).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in keep])
