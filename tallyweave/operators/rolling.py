"""Rolling totals and averages over trailing calendar periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def daily_totals(df: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """Sum of ``value`` per entity and day (``entity, day, total, n``); NULL values count as 0.

    Rows with a NULL entity or day are left out. Partial sums are made before the shuffle,
    so a hot entity leaves at most one row per day and task.
    """
    return (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(day).cast("date").alias("day"))
        .agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("total"), F.count(F.lit(1)).alias("n"))
    )


def densify_days(daily: DataFrame) -> DataFrame:
    """Every day of each entity from its first to its last, with 0 where nothing happened.

    Entity by calendar, without a join: each active day is expanded by a generator over the
    days up to the next active day, so the calendar costs no shuffle beyond the one by entity.
    An empty input gives an empty result; an entity with one day gives one row.
    """
    w = Window.partitionBy("entity").orderBy("day")
    upto = F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day"))
    spans = daily.withColumn("days", F.sequence(F.col("day"), upto))
    out = spans.select("entity", F.col("day").alias("__d0"), "total", "n", F.explode("days").alias("day"))
    live = F.col("day") == F.col("__d0")
    return out.select(
        "entity",
        "day",
        F.when(live, F.col("total")).otherwise(F.lit(0).cast(daily.schema["total"].dataType)).alias("total"),
        F.when(live, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n"),
    )


def trailing_totals(
    df: DataFrame, entity: str, day: str, value: str, periods: Sequence[int] = (7, 30)
) -> DataFrame:
    """Totals and averages over trailing periods ending each day, days without activity included.

    ``df``     one row per fact; the columns ``entity``, ``day`` (date or timestamp, UTC) and
               ``value`` (integer or decimal) are named by the caller, others are ignored.
    Returns    ``entity, day, total, n`` of the day and ``total_P``, ``avg_P`` per period P; the
               period holds the day itself and the P-1 days before it, and the average divides
               by P. Before an entity's first day there is nothing, which counts as 0.

    Steps: aggregate per entity and day; densify by the entity's calendar; window sums over a
    fixed number of preceding rows, for exact numbers as differences of one running sum. One shuffle by (entity, day), one by entity. The window
    holds at most one row per day and entity, however many facts an entity has.
    """
    dense = densify_days(daily_totals(df, entity, day, value))
    w = Window.partitionBy("entity").orderBy("day")
    if isinstance(dense.schema["total"].dataType, (FloatType, DoubleType)):
        out = dense.withColumns({f"total_{p}": F.sum("total").over(w.rowsBetween(-(p - 1), 0)) for p in periods})
    else:
        # Exact numbers: the sum of the P rows up to here is the running sum less what it was P rows before, whatever P.
        run = dense.withColumn("__run", F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = run.withColumns({f"total_{p}": F.col("__run") - F.coalesce(F.lag("__run", p).over(w), F.lit(0)) for p in periods}).drop("__run")
    return out.select("*", *[F.try_divide(F.col(f"total_{p}").cast("double"), F.lit(p)).alias(f"avg_{p}") for p in periods])
