"""Identifiers typed or exported unevenly, brought to the form they denote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_id(c: Column) -> Column:
    """The identifier a string denotes, or NULL for a blank one.

    White space of any kind around it, letter case, a decimal tail ``.0`` left by a
    spreadsheet and zeros padded before an all-digit id carry no meaning.
    """
    v = F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Cc}\p{Cf}]+|[\s\p{Cc}\p{Cf}]+$", ""))
    v = F.regexp_replace(v, r"^[{](.*)[}]$", "$1")
    v = F.regexp_replace(v, r"^(\d+)\.0+$", "$1")
    v = F.regexp_replace(v, r"^0+(?=\d+$)", "")
    return F.nullif(v, F.lit(""))
