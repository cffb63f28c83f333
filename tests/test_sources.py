"""Pages with failures, files, mirrors and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.sources.files import cues, json_lines, page_tables, text_files
from tallyweave.sources.mirror import Mirror, preview
from tallyweave.sources.paged import PagedSource, Unavailable, _Reader, parquet_pages, retried
from tallyweave.streaming.flows import file_stream, keep_newest, last_seen


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise Unavailable("busy", wait=99 if len(calls) == 3 else None)
        return "done"

    assert retried(call, sleep=waits.append) == "done" and waits == [1.0, 2.0, 30.0]
    with pytest.raises(Unavailable):
        retried(lambda: (_ for _ in ()).throw(Unavailable()), tries=2, sleep=waits.append)


def breaks_off(at, cursor, size):
    if cursor:
        raise Unavailable("gone", wait=0.0)
    return {"rows": [(1,)], "next": 1}


def test_a_chain_that_breaks_is_an_error():
    reader = _Reader({"fetch": f"{__name__}:breaks_off", "by": "cursor", "tries": "2"})
    with pytest.raises(Unavailable):
        list(reader.read(reader.partitions()[0]))


def test_pages(spark, tmp_path):
    spark.range(57).select(F.col("id"), F.concat(F.lit("n"), "id").alias("s")).write.parquet(str(tmp_path / "t"))
    spark.dataSource.register(PagedSource)
    for by in ("offset", "cursor"):
        df = spark.read.format("paged").schema("id long, s string").options(fetch="tallyweave.sources.paged:parquet_pages", at=f"{tmp_path / 't'}?id,s", page="10", by=by).load()
        assert sorted(r["id"] for r in df.collect()) == list(range(57))
    assert parquet_pages(f"{tmp_path / 't'}?id", 90, 10) == {"rows": [], "next": None}


def test_page_tables(spark):
    pages = spark.createDataFrame([([("a", 1)], [("x",)]), ([("b", 2)], [("x",)]), ([], [])], "data array<struct<k:string,n:int>>, included array<struct<g:string>>")
    data, side = page_tables(pages)
    assert sorted(map(tuple, data.collect())) == [("a", 1), ("b", 2)] and [tuple(r) for r in side.collect()] == [("x",)]


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("﻿one\ntwo", encoding="utf-8")
    (tmp_path / "deep" / "b.txt").write_text("")
    (tmp_path / "c.md").write_text("no")
    assert [r["text"] for r in text_files(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    (tmp_path / "x.json").write_text('{"k": 1}\n{bad\n{"k": "no"}\n\n{"k": 2}\n')
    assert sorted(r["k"] for r in json_lines(spark, str(tmp_path / "x.json"), "k int").collect()) == [1, 2]


def test_cues(spark):
    vtt = "WEBVTT\n\n1\n00:01:01.500 --> 00:01:02.000 align:left\nThe road\r\nback\n\n02.250 --> 03.000\n\nNOTE x"
    got = spark.createDataFrame([(vtt,), ("",), (None,)], "t string").select(cues(F.col("t")).alias("c")).collect()
    assert [tuple(c) for c in got[0]["c"]] == [(61.5, 62.0, "The road back"), (2.25, 3.0, "")] and got[1]["c"] == [] and got[2]["c"] is None


def test_mirror(spark, tmp_path):
    t = Mirror(spark, str(tmp_path / "m"))
    assert t.version() == 0
    with pytest.raises(FileNotFoundError):
        t.read()
    t.write(spark.createDataFrame([("a", 1)], "k string, n int"))
    new = spark.createDataFrame([("a", 2), ("b", 3)], "k string, n int")
    assert {r["kind"]: r["n"] for r in preview(t.read(), new, ["k"], ["n"]).collect()} == {"update": 1, "insert": 1}
    t.upsert(new, ["k"], [F.col("n")])
    t.append(spark.createDataFrame([("c", 9)], "k string, n int"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 2), ("b", 3), ("c", 9)] and t.version() == 3
    (tmp_path / "m" / "v=4").mkdir()  # a run that died
    assert t.version() == 3 and sorted(p.name for p in (tmp_path / "m").iterdir()) == ["v=2", "v=3", "v=4"]
    assert t.upsert(new.limit(0), ["k"], [F.col("n")]).count() == 3 and t.version() == 4


def test_streams_are_the_same_as_batches(spark, tmp_path):
    day = lambda n: dt.datetime(2025, 1, n)
    parts = [[("a", day(3), 1), ("b", day(1), 5), (None, day(1), 0)], [("a", day(2), 7), ("a", day(3), 2), ("c", None, 1)], [("b", day(9), None)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "k string, at timestamp_ntz, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = keep_newest(file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "s1"), ["k"], "at", ["n"])
    assert sorted(map(tuple, kept.collect())) == [("a", day(3), 2), ("b", day(9), None)]
    seen = last_seen(file_stream(spark, str(tmp_path / "in"), 1).select("k", "at"), str(tmp_path / "s2"), "k", "at")
    assert sorted(map(tuple, seen.collect())) == [("a", day(3)), ("b", day(9))]
    # More arrives: the stream goes on where it was.
    spark.createDataFrame([("a", day(8), 4)], "k string, at timestamp_ntz, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = keep_newest(file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "s1"), ["k"], "at", ["n"])
    assert sorted(map(tuple, kept.collect())) == [("a", day(8), 4), ("b", day(9), None)]
