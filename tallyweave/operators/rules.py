"""Rules kept as data: so many events of a kind within so many days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fired(rules: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """``who, code, rank, n``: every enabled rule that someone's events meet.

    ``rules (code, signal, threshold, window_days, rank, enabled)`` are few rows; a NULL threshold
    is once, a NULL window is ever. ``events (who, signal, at)``; events without a person, of an
    unknown signal, or without a time where a window asks for one, meet nothing. Events are counted
    by person, signal and day before they meet the rules, so a busy person is a row a day.
    """
    days = events.where(F.col("who").isNotNull()).groupBy("who", "signal", F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    live = F.broadcast(rules.where("enabled").select("code", "signal", "threshold", "window_days", "rank"))
    inside = F.col("window_days").isNull() | (F.col("day") > F.date_sub(as_of.cast("date"), F.col("window_days")))
    counts = days.join(live, "signal").where(inside).groupBy("who", "code", "rank", "threshold").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= F.coalesce("threshold", F.lit(1))).select("who", "code", "rank", "n")


def verdicts(hits: DataFrame) -> DataFrame:
    """``who, rank, reasons``: the highest rank of the rules someone meets, and the codes of all of them in order."""
    return hits.groupBy("who").agg(F.max("rank").alias("rank"), F.array_sort(F.collect_set("code")).alias("reasons"))
