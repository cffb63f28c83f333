"""Scalar functions on rows that break things."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import nested, search, text, times
from tallyweave.plans.scalars import clamped, recency_step
from tallyweave.streaming.flows import clock_state


def each(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, values, want",
    [
        (text.norm_email, [" A@B.CO ", "a@b", "a.b@c", "x@y@z.co", "\ta@b.co\n", None, ""], ["a@b.co", None, None, "x@y@z.co", "a@b.co", None, None]),
        (text.norm_phone, ["+1 (743) 555-3824", "5553824", "17435553824", "abc", None, ""], ["7435553824", None, "7435553824", None, None, None]),
        (text.first_word, ["  Ana   Maria  Lopez ", "Cher", "", None], ["Ana", "Cher", None, None]),
        (text.other_words, ["  Ana   Maria  Lopez ", "Cher", "", None], ["Maria Lopez", None, None, None]),
        (times.any_date, ["2024-01-02", "1/2/2024", "01/02/2024", "Jan 2 2024", None], [dt.date(2024, 1, 2)] * 3 + [None, None]),
        (times.clock_seconds, ["1:02:03", "2:03", "45", "a:b", None], [3723, 123, None, None, None]),
        (times.compact_date, ["20240102", "2024", None], ["2024-01-02", None, None]),
        (times.lenient_time, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00", "2024-01-02T05:04:05+02:00", "2024-13-01", "", None], [dt.datetime(2024, 1, 2, 3, 4, 5)] * 3 + [None] * 3),
        (nested.whole, ["3.0", "7.9", "", "x", None], [3, 7, 0, 0, 0]),
        (text.title_case, ["O'NEIL MARY-ANN", "ßé", "", None], ["O'Neil Mary-Ann", "SSé", "", None]),
        (lambda c: text.url_param(c, "v"), ["http://x/?a=1&v=b-c_d", "http://x/v=1", None], ["b-c_d", None, None]),
        (lambda c: text.ranked(c, ("a", "b", "c")), ["a", "c", "z", None], [0, 2, 0, 0]),
        (lambda c: text.first_keyword(c, ("b", "A")), ["xxAB", "a", "q", None], ["b", "A", None, None]),
        (text.html_escaped, ["<a href=\"x\">'&", None], ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;", None]),
    ],
)
def test_each(spark, f, values, want):
    assert each(spark, f, values) == want


def test_header(spark):
    rule = "======"
    values = ["no rules", f"{rule}\na: 1", f"{rule}\nA: 1\nb : x: y\n a: 2\nplain\n{rule}\nc: 3", "", None, f"=====\na: 1\n{rule}\nb: 2\n{rule}"]
    assert each(spark, text.header_block, values) == [{}, {}, {"a": "2", "b": "x: y"}, {}, None, {"b": "2"}]


def test_fold_compares_with_the_last_kept(spark):
    df = spark.createDataFrame([(["grace and mercy", "mercy", "grace and mercy"],), (["a", "b", "b", "a"],), ([],), (None,), (["a", None, "a"],)], "v array<string>")
    got = [r[0] for r in df.select(text.folded_lines("v")).collect()]
    assert got[:4] == [["grace and mercy"], ["a", "b", "a"], [], None]


def test_captions(spark):
    vtt = "﻿WEBVTT\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02.000\n<c>The road</c> back\n\n00:00:02.000 --> 00:00:03.000\nroad back\n[Music]\n"
    assert each(spark, text.caption_lines, [vtt, "", None]) == [["The road back"], [], None]


def test_chunks(spark):
    df = spark.createDataFrame([(["a."] * 9,), (["w " * 130, "b."],), ([],), (None,)], "v array<string>")
    got = [r[0] for r in df.select(text.chunked(F.col("v"))).collect()]
    assert got[0] == ["a. a. a. a.", "a. a. a. a.", "a."] and len(got[1]) == 2 and got[2] == [] and got[3] is None


def test_first_priced(spark):
    kind = "array<struct<action_type:string,value:string>>"
    rows = [[("lead", "0"), ("click", "3.0")], [("lead", "2"), ("lead", "5")], [], None, [("other", "9"), (None, "1")]]
    got = each(spark, lambda c: nested.first_priced(c, ("lead", "click")), rows, kind)
    assert [g and tuple(g) for g in got] == [("click", 3), ("lead", 5), None, None, None]
    assert each(spark, lambda c: nested.summed(c, "lead"), rows, kind) == [0, 7, 0, 0, 0]


def test_clock_at_its_edges(spark):
    day = dt.timedelta(days=1)
    now, us = dt.datetime(2026, 1, 1), dt.timedelta(microseconds=1)
    values = [now - 180 * day, now - 180 * day - us, now - 730 * day, now - 730 * day - us, None, now + day]
    at = F.expr("timestamp_ntz'2026-01-01'")
    assert each(spark, lambda c: clock_state(c, at), values, "timestamp_ntz") == ["active", "dormant", "dormant", "inactive", "inactive", "active"]
    assert each(spark, recency_step, [dt.datetime(2025, 12, 1), dt.datetime(2025, 12, 1) + us, None, dt.datetime(1990, 1, 1)], "timestamp_ntz") == [2, 1, 7, 6]


def test_settings():
    assert [clamped(v, 30, 1, 365) for v in (None, "", "x", "0", "4000", "12")] == [30, 30, 30, 1, 365, 12]


def test_typed_query(spark):
    assert search.parsed_query('grace or mercy -"the road back" table') == ([[("grace",), ("mercy",)], [("table",)]], [("road", "back")])
    df = spark.createDataFrame([(1, "Graces and tables", None), (2, "the road back, grace, table", "x"), (3, "mercy", "table"), (4, None, None)], "id int, a string, b string")
    got = {r["id"]: r["rank"] for r in search.search(df, "id", {"a": "A", "b": "C"}, 'grace or mercy -"the road back" table').collect()}
    assert set(got) == {1, 3} and got[1] > got[3] > 0
    assert search.search(df, "id", {"a": "A"}, "the").count() == 0
