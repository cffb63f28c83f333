"""Variant spellings of names typed by people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .people import identify


def name_classes(records: DataFrame) -> DataFrame:
    """``key, spelling, name``: the strings written for one person or organisation, with the smallest of them.

    ``records`` has ``name, email, phone, pid``. Words within one edit, equal ones included, come
    from the trie join over given and family names: a word the tries don't hand on makes no class.
    Both orders of a name's words are then checked against the names that are written elsewhere,
    short names and initials included, and contacts settle whom an initial or a bare given name
    stands for. Stand-ins, blanks and addresses typed as names are in no class. Each string counts
    once per key, however many rows carry it; an empty table gives no rows.
    """
    who = identify(records).where(F.col("name").isNotNull() & F.col("given").isNotNull() & F.col("kind").isin("person", "org"))
    keyed = who.select("key", "name").distinct()
    first = keyed.groupBy("key").agg(F.min("name").alias("spelling"))
    return keyed.join(first, "key").select("key", "spelling", "name")


def name_variants(records: DataFrame) -> DataFrame:
    """Pairs ``name_a < name_b`` of different strings of one class (``name_classes``), each pair once."""
    keyed = name_classes(records)
    a, b = keyed.select("key", F.col("name").alias("name_a")), keyed.select("key", F.col("name").alias("name_b"))
    return a.join(b, "key").where("name_a < name_b").select("name_a", "name_b").distinct()
