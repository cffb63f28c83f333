"""Joins, sets and keyed tables that SQL has no one word for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the first row in the given order; ties must be ended by the order itself.

    An aggregate with a struct, so rows of a hot key are reduced before the shuffle. Rows with a
    NULL key are a group of their own.
    """
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("__row")) if rest else df.select(*keys).distinct()
    return kept.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def cascade_join(left: DataFrame, right: DataFrame, key: str, target: str, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """``key, target, step``: for each left row the right row it meets by the first key that meets any.

    ``steps`` are pairs of a left and a right column, the most trusted first; ``step`` says which
    pair decided (from 1), NULL if none did. A right key held by several rows stands for the
    smallest ``target``, so a left row gets one match at most. NULL keys meet nothing. Equi joins
    only; no OR-join, so nothing is compared pairwise.
    """
    out = left.select(key, *dict.fromkeys(a for a, _ in steps))
    for i, (a, b) in enumerate(steps, 1):
        side = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias(a)).agg(F.min(target).alias(f"__m{i}"))
        out = out.join(side, a, "left")
    hits = [F.col(f"__m{i}") for i in range(1, len(steps) + 1)]
    step = reduce(lambda c, i: c.when(hits[i].isNotNull(), i + 1), range(1, len(hits)), F.when(hits[0].isNotNull(), 1))
    return out.select(key, F.coalesce(*hits).alias(target), step.alias("step"))


def with_flags(df: DataFrame, key: str, **sides: DataFrame) -> DataFrame:
    """``df`` with one boolean per side: whether the side has the key. Rows are neither lost nor repeated; a NULL key has none."""
    for name, side in sides.items():
        df = df.join(side.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def star_pairs(df: DataFrame, group: str, key: str, order: Sequence[Column]) -> DataFrame:
    """``group, first, other``: the first holder of each group value with every later one.

    Holders count once. A group of n gives n - 1 rows, never all pairs. NULL groups give none.
    """
    held = df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).groupBy(group, key).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__at"))
    first = held.groupBy(group).agg(F.min_by(key, F.struct("__at", key)).alias("first"))
    return held.join(first, group).where(F.col(key) != F.col("first")).select(group, "first", F.col(key).alias("other"))


def divided(done: DataFrame, required: DataFrame, who: str, group: str, item: str, at: str | None = None) -> DataFrame:
    """Relational division: ``who, group, last`` for everyone who has all items of a group.

    ``required (group, item)``, ``done (who, item[, at])``; ``last`` is when the last of them was
    first done. Repeats count once; a group without items is complete for nobody.
    """
    need = required.select(group, item).distinct()
    size = need.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    once = done.where(F.col(who).isNotNull()).groupBy(who, item).agg(F.min(at if at else F.lit(None)).alias("__at"))
    got = once.join(need, item).groupBy(who, group).agg(F.count(F.lit(1)).alias("__n"), F.max("__at").alias("last"))
    return got.join(size, group).where(F.col("__n") == F.col("__size")).select(who, group, "last")


def month_spine(df: DataFrame, month: str, first: str, months: int) -> DataFrame:
    """``df`` on a gap-free row of months from ``first`` (a date); months outside it are dropped, missing ones have NULLs."""
    spine = df.sparkSession.range(months).select(F.add_months(F.lit(first).cast("date"), F.col("id").cast("int")).alias(month))
    return spine.join(df, month, "left")


def monthly_series(events: Sequence[tuple[str, DataFrame, str, Column]], first: str, months: int) -> DataFrame:
    """Several monthly series side by side: ``month`` and one column each, 0 where nothing happened.

    ``events`` are (name, table, time column, value to sum). All are made into one long table, so
    there is one shuffle for any number of series.
    """
    long = [df.select(F.trunc(F.col(at).cast("date"), "month").alias("month"), *[(value if n == name else F.lit(0)).cast("bigint").alias(n) for n, *_ in events]) for name, df, at, value in events]
    sums = reduce(DataFrame.unionByName, long).groupBy("month").agg(*[F.sum(n).alias(n) for n, *_ in events])
    return month_spine(sums, "month", first, months).na.fill(0)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column], nulls: str = "keep") -> DataFrame:
    """``target`` after ``source`` was merged into it by key.

    Columns the source lacks stay. Of a key that comes twice in the source the first row by
    ``order`` counts. With ``nulls='keep'`` a NULL in the source leaves the old value, with
    ``'overwrite'`` it replaces it. Rows of the source with a NULL key are left out.
    """
    for k in keys:
        source = source.where(F.col(k).isNotNull())
    news = first_of_each(source, keys, order)
    given = [c for c in news.columns if c not in keys and c in target.columns]
    side = news.select(*keys, *[F.col(c).alias(f"__{c}") for c in given], F.lit(True).alias("__new"))
    both = target.join(side, list(keys), "full_outer")
    value = lambda c: F.coalesce(f"__{c}", c) if nulls == "keep" else F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))
    return both.select(*[value(c).alias(c) if c in given else F.col(c) for c in target.columns])


def replaced_groups(target: DataFrame, source: DataFrame, group: str, touched: DataFrame) -> DataFrame:
    """``target`` with all rows of the ``touched`` groups taken out and the source's rows of them put in; an emptied group goes."""
    ids = touched.select(group).distinct()
    return target.join(ids, group, "left_anti").unionByName(source.join(ids, group, "left_semi").select(*target.columns))


def inserted_missing(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``target`` with the source rows whose key it lacks, one each (insert, on conflict do nothing)."""
    return target.unionByName(first_of_each(source, keys, order).join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def arg_by_sum(df: DataFrame, keys: Sequence[str], category: str, weight: str) -> DataFrame:
    """Of each key the category of the largest summed weight; ties take the smallest category, NULL ones are left out."""
    sums = df.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.sum(weight).alias("__w"))
    return sums.groupBy(*keys).agg(F.min_by(category, F.struct(-F.col("__w"), F.col(category))).alias(category), F.max("__w").alias("weight"))


def with_share(df: DataFrame, value: str, share: str = "share") -> DataFrame:
    """``df`` with each row's share of the sum over all rows; 0 of nothing. The sum is a scalar subquery, so nothing is gathered or joined."""
    whole = df.agg(F.sum(value)).scalar()
    return df.withColumn(share, F.coalesce(F.try_divide(F.col(value).cast("double"), whole.cast("double")), F.lit(0.0)))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order that ends with a unique key."""
    return df.orderBy(*order).limit(n)


