"""Connected components of rows that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stable


def components(rows: DataFrame, row: str, key: str) -> DataFrame:
    """``row, component``: rows joined by keys they share, directly or over others; the component is its smallest row.

    ``rows (row, key)`` has a line for each key of each row; NULLs are left out. Every round gives a
    row the smallest label around its keys and then that label's own label, so chains halve and the
    rounds grow with the logarithm of the longest one. A key of a third of all rows is reduced to
    one label before it is shuffled; no pairs are made. Lineage is cut every round.
    """
    links = stable(rows.where(F.col(row).isNotNull() & F.col(key).isNotNull()).select(F.col(row).alias("r"), F.col(key).alias("k")).distinct())
    label = links.select("r", F.col("r").alias("l")).distinct()
    while True:
        low = links.join(label, "r").groupBy("k").agg(F.min("l").alias("low"))
        near = links.join(low, "k").groupBy("r").agg(F.min("low").alias("low"))
        near = label.join(near, "r").select("r", "l", F.least("l", "low").alias("low"))
        far = near.select(F.col("r").alias("low"), F.col("low").alias("new"))
        step = stable(near.join(far, "low").select("r", F.col("new").alias("l"), (F.col("new") < F.col("l")).alias("moved")))
        label = step.drop("moved")
        if step.where("moved").isEmpty():
            return label.select(F.col("r").alias(row), F.col("l").alias("component"))
