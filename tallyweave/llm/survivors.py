"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivors(records: DataFrame, group: str, rid: str, fields: Mapping[str, tuple[Column, list[Column]]]) -> DataFrame:
    """For each group of two records or more and each field, the value that survives.

    ``fields`` maps a field to ``(value, priority)``: the usable value (NULL where the record has
    none) and the sort keys by which records are believed, best first, all ascending. One row per
    group and field with a usable value: ``group_id`` (smallest ``rid``), ``size``, ``field_name``,
    ``value`` (string) and ``source_id``.

    One aggregation: per field the extreme of one composite struct (unusable last, priorities, id),
    so groups of any size combine map-side and nothing is collected. Ties end with the smallest id;
    rows repeated whole change nothing; records with a NULL group or id are left out.
    """
    rows = records.where(F.col(group).isNotNull() & F.col(rid).isNotNull())
    best = []
    for name, (value, priority) in fields.items():
        # NULLs sort first in a struct, so each priority carries a flag that puts them last.
        keys = [x for i, p in enumerate(priority) for x in (p.isNull().alias(f"n{i}"), p.alias(f"k{i}"))]
        best.append(F.min(F.struct(value.isNull().alias("none"), *keys, F.col(rid).alias("id"), value.cast("string").alias("v"))).alias(f"__{name}"))
    one = rows.groupBy(group).agg(F.min(rid).alias("group_id"), F.min(rid).alias("lo"), F.max(rid).alias("hi"), F.count(F.lit(1)).alias("size"), *best)
    picked = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"__{n}.none").alias("none"), F.col(f"__{n}.v").alias("value"), F.col(f"__{n}.id").alias("source_id")) for n in fields]))
    return one.where("lo < hi").select("group_id", "size", picked.alias("f")).where("NOT f.none").select("group_id", "size", "f.field_name", "f.value", "f.source_id")
