"""Relational operators against plain Python, and on nulls, ties, repeats and empty tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyweave.operators.components import components
from tallyweave.operators.relations import arg_by_sum, cascade_join, divided, first_of_each, inserted_missing, month_spine, replaced_groups, star_pairs, upsert, with_flags, with_share
from tallyweave.operators.rolling import trailing_totals
from tallyweave.operators.rowwise import mapped_rows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_trailing_totals_against_sums(spark):
    rng = random.Random(1)
    first = dt.date(2025, 1, 1)
    facts = [(rng.choice(["a", "b"]), first + dt.timedelta(days=rng.randrange(80)), rng.choice([1, 5, None])) for _ in range(60)] + [(None, first, 1), ("a", None, 1), ("c", first, 2)]
    df = spark.createDataFrame(facts, "who string, day date, v int").withColumn("total", F.lit("clash"))
    got = {(r["entity"], r["day"]): (r["total"], r["n"], r["total_7"], r["total_30"], round(r["avg_7"], 9)) for r in trailing_totals(df, "who", "day", "v").collect()}
    want = {}
    for who in "abc":
        own = [(d, v or 0) for w, d, v in facts if w == who and d]
        lo, hi = min(own)[0], max(own)[0]
        for k in range((hi - lo).days + 1):
            d = lo + dt.timedelta(days=k)
            over = lambda n: sum(v for x, v in own if 0 <= (d - x).days < n)  # noqa: B023, E731
            want[who, d] = (over(1), sum(x == d for x, _ in own), over(7), over(30), round(over(7) / 7, 9))
    assert got == want
    # Numbers that are not exact go by frames of rows, with the same result.
    floats = {(r["entity"], r["day"]): (r["total"], r["n"], r["total_7"], r["total_30"], round(r["avg_7"], 9)) for r in trailing_totals(df.withColumn("v", F.col("v").cast("double")), "who", "day", "v").collect()}
    assert floats == want
    assert trailing_totals(df.limit(0), "who", "day", "v").count() == 0


def test_cascade(spark):
    left = spark.createDataFrame([("l1", "p1", "e2"), ("l2", None, "e2"), ("l3", None, None), ("l4", "zz", "e1")], "l string, p string, e string")
    right = spark.createDataFrame([("r1", "p1", "e1"), ("r2", None, "e2"), ("r0", None, "e2"), ("r9", None, None)], "r string, p string, e string")
    assert rows(cascade_join(left, right, "l", "r", [("p", "p"), ("e", "e")])) == [("l1", "r1", 1), ("l2", "r0", 2), ("l3", None, None), ("l4", "r1", 2)]


def test_flags_and_shares(spark):
    df = spark.createDataFrame([("a", 1), (None, 3), ("b", 0)], "k string, v int")
    side = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(with_flags(df, "k", there=side)) == [("a", 1, True), ("b", 0, False), (None, 3, False)]
    assert [round(r["share"], 2) for r in with_share(df, "v").orderBy("v").collect()] == [0.0, 0.25, 0.75]
    assert with_share(df.limit(0), "v").count() == 0


def test_first_and_stars(spark):
    df = spark.createDataFrame([("n", "x", 2), ("n", "y", 1), ("n", "y", 5), ("n", "z", 2), (None, "q", 1), ("m", "x", 1)], "g string, k string, t int")
    assert rows(first_of_each(df, ["g"], [F.col("t"), F.col("k")])) == [("m", "x", 1), ("n", "y", 1), (None, "q", 1)]
    assert rows(star_pairs(df, "g", "k", [F.col("t")])) == [("n", "y", "x"), ("n", "y", "z")]


def test_division(spark):
    need = spark.createDataFrame([("c", "1"), ("c", "2"), ("c", "2"), ("d", "9")], "course string, item string")
    done = spark.createDataFrame([("u", "1", 5), ("u", "2", 7), ("u", "2", 3), ("v", "1", 1), ("v", "1", 1), ("w", "2", 1), ("w", "1", 2), ("w", "3", 9), (None, "9", 1)], "who string, item string, at int")
    assert rows(divided(done, need, "who", "course", "item", "at")) == [("u", "c", 5), ("w", "c", 2)]
    assert divided(done, need.limit(0), "who", "course", "item").count() == 0


def test_arg_by_sum(spark):
    df = spark.createDataFrame([("k", "b", 2), ("k", "a", 1), ("k", "a", 1), ("k", None, 99), ("n", None, 1)], "k string, c string, w int")
    assert rows(arg_by_sum(df, ["k"], "c", "w")) == [("k", "a", 2)]


def test_spine(spark):
    df = spark.createDataFrame([(dt.date(2025, 2, 1), 4), (dt.date(2020, 1, 1), 9)], "month date, n int")
    assert rows(month_spine(df, "month", "2025-01-01", 3)) == [(dt.date(2025, 1, 1), None), (dt.date(2025, 2, 1), 4), (dt.date(2025, 3, 1), None)]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x", "o"), ("b", 2, "y", "o")], "k string, n int, s string, own string")
    new = spark.createDataFrame([("a", None, "z"), ("c", 3, None), ("c", 4, "late"), (None, 9, "w")], "k string, n int, s string")
    order = [F.col("n")]
    assert rows(upsert(old, new, ["k"], order)) == [("a", 1, "z", "o"), ("b", 2, "y", "o"), ("c", 3, None, None)]
    assert rows(upsert(old, new, ["k"], order, nulls="overwrite")) == [("a", None, "z", "o"), ("b", 2, "y", "o"), ("c", 3, None, None)]
    assert rows(upsert(old, new.limit(0), ["k"], order)) == rows(old)
    assert rows(inserted_missing(old.select("k", "n", "s"), new.where("k is not null"), ["k"], order)) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)]


def test_replaced_groups(spark):
    old = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "3"), ("i", "4")], "g string, m string")
    new = spark.createDataFrame([("g", "2"), ("g", "5"), ("i", "9")], "g string, m string")
    touched = spark.createDataFrame([("g",), ("h",), ("g",)], "g string")
    assert rows(replaced_groups(old, new, "g", touched)) == [("g", "2"), ("g", "5"), ("i", "4")]


def test_components_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(f"r{rng.randrange(60):02d}", f"k{rng.randrange(70)}") for _ in range(70)] + [(f"r{i:02d}", f"chain{j}") for i in range(60, 90) for j in (i, i + 1)] + [(None, "k1"), ("r00", None)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r, k in pairs:
        if r and k:
            a, b = sorted((top("r" + r), top("~" + k)))
            up[b] = a
    want = {r: top("r" + r)[1:] for r, k in pairs if r and k}
    got = {r["rec"]: r["component"] for r in components(spark.createDataFrame(pairs, "rec string, k string"), "rec", "k").collect()}
    assert got == want
    assert components(spark.createDataFrame([], "rec string, k string"), "rec", "k").count() == 0


def test_rowwise_hook(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    call = lambda s: [None if not isinstance(v, str) else {"n": v * 2} for v in s]
    assert rows(mapped_rows(df, "k", "t", "n string", call)) == [(1, "aa"), (2, None)]
    assert rows(mapped_rows(df, "k", "t", "n string")) == [(1, None), (2, None)]
