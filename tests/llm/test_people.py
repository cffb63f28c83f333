"""Local phone numbers as evidence for matching (p4)."""

from pyspark.sql import functions as F

from tallyweave.llm.matching import match_entities
from tallyweave.llm.people import local_phone, own_contact, usable_phone

COLS = "tab string, id string, rec string, name string, email string, phone string, pid string, takes_part boolean"


def test_local_phone(spark):
    rows = [("(928) 143-5967 x12",), ("143-5967",), ("5555555",), ("123-4567",), ("12",), (None,), ("0000000000",)]
    df = spark.createDataFrame(rows, "c string").select(local_phone(F.col("c")).alias("s"), usable_phone(F.col("c")).alias("p"), own_contact(F.lit(None).cast("string"), F.col("c")).alias("own"))
    got = [tuple(r) for r in df.collect()]
    assert got[:2] == [("1435967", "9281435967", True), ("1435967", None, True)]
    assert got[2:] == [(None, None, False)] * 5


def test_local_number_matches(spark):
    rows = [
        ("ghl_opportunities", "o1", "Philip Femosinay", None, "143-5967"),
        ("meta_leads", "l1", "Philip Femosinay", None, "928 143 5967"),
        ("ghl_opportunities", "o2", "Grace Wolitan", None, "none"),
        ("meta_leads", "l2", "Grace Wolitan", "grace.wolitan@mail.example", None),
    ]
    rows += [(t, f"{t[0]}{i}", f"Name{chr(97 + i)} Family{chr(97 + i) * 3}", f"box{chr(97 + i)}@mail.example", None) for i in range(20) for t in ("ghl_opportunities", "meta_leads")]
    df = spark.createDataFrame([(t, i, f"{t}|{i}", n, e, p, None, True) for t, i, n, e, p in rows], COLS)
    got = {(r["id_a"], r["id_b"]) for r in match_entities(df).collect()}
    assert ("o1", "l1") in got and not any("o2" in x for x in got)
