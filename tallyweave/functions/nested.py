"""Numbers in text, ratios, and lists of structs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A number in text; NULL, empty and unreadable count as 0."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")).try_cast("double"), F.lit(0.0))


def whole(c: Column) -> Column:
    """The same, cut to an integer."""
    return number(c).cast("bigint")


def rate(part: Column, of: Column) -> Column:
    """Per cent; 0 of nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), of.cast("double")) * 100, F.lit(0.0))


def cost(spend: Column, results: Column) -> Column:
    """Per result; NULL without results."""
    return F.try_divide(spend.cast("double"), results.cast("double"))


def by_name(items: Column, name: str, value: str) -> Column:
    """A list of structs as a map; of a name given twice the last one stays, NULL names are left out."""
    kept = F.filter(items, lambda p, i: p[name].isNotNull() & (F.size(F.filter(items, lambda q, j: (j > i) & (q[name] == p[name]))) == 0))
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p[name].alias("key"), p[value].alias("value"))))


def first_priced(items: Column, order: Sequence[str], name: str = "action_type", value: str = "value") -> Column:
    """``(kind, n)`` of the first kind of an order that the list has with a number other than 0; NULL if none."""
    held = by_name(items, name, value)
    kinds = F.transform(F.array(*[F.lit(x) for x in order]), lambda k: F.struct(k.alias("kind"), whole(F.try_element_at(held, k)).alias("n")))
    return F.get(F.filter(kinds, lambda s: s["n"] != 0), F.lit(0))


def summed(items: Column, kind: str, name: str = "action_type", value: str = "value") -> Column:
    """Sum over the entries of one kind; 0 if there is none."""
    return F.aggregate(F.filter(F.coalesce(items, F.array().cast("array<struct<action_type:string,value:string>>")), lambda a: a[name] == kind), F.lit(0).cast("bigint"), lambda s, a: s + whole(a[value]))


def holds(items: Column, x: Column) -> Column:
    """Membership, false where a NULL in the list would leave it open."""
    return F.coalesce(F.array_contains(items, x), F.lit(False))
