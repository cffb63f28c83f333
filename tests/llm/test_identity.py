"""p2, p3 and p4 against brute force on small tables, and on the rows that break things."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.llm.matching import K1, LEAST, WHOLE, B, _two_edits, contradicted, fit_logistic, match_entities, mutual_nearest, retrieve
from tallyweave.llm.names import parse_name
from tallyweave.llm.people import identify, kept_email, usable_email, usable_phone
from tallyweave.llm.spelling import _trie, trie_neighbours, usual_spelling, within, within_one
from tallyweave.llm.survivors import survivors
from tallyweave.llm.variants import name_classes, name_variants


def edits(a, b):
    """Edits with swaps of neighbours, each letter touched once."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def near_words(n, seed):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        words.add(w)
        k = rng.randrange(len(w))
        words |= {w[:k] + rng.choice("abc") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]}
    return sorted(words - {""})


def test_within_against_all_words():
    words = near_words(150, 1)
    trie = _trie(words)
    for bound in (0, 1, 2):
        for q in words[::9]:
            assert sorted(within(trie, q, bound)) == sorted(w for w in words if edits(q, w) <= bound)
    assert all(sorted(within_one(trie, q)) == sorted(within(trie, q, 1)) for q in [*words, "", "z", "abcabcabcabcabcabc"])
    assert within_one({}, "a") == set() and within_one(_trie([""]), "a") == {""} and within_one(_trie(["a"]), "") == {"a"}


def test_trie_join_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr("tallyweave.llm.spelling.TRIE_WORDS", 20)  # several tries a shard
    words = near_words(250, 2)
    rows = [("x", w, 1) for w in words] * 2 + [("y", "abcab", 3), (None, "q", 1), ("x", None, 1)]
    got = {(r["a"], r["b"]) for r in trie_neighbours(spark.createDataFrame(rows, "tag string, word string, a int")).where("tag = 'x'").collect()}
    want = {(a, b) for a in words for b in words if a == b or len(a) > 2 and len(b) > 2 and edits(a, b) <= 1}
    assert got == want


def test_trie_join_of_nothing(spark):
    assert trie_neighbours(spark.createDataFrame([], "tag string, word string")).count() == 0


def test_usual_spelling(spark):
    near = spark.createDataFrame([("g", "ana", "ana", 1, 1), ("g", "ana", "anna", 1, 9), ("g", "ana", "ann", 1, 20), ("g", "anna", "anna", 9, 9)], "tag string, a string, b string, na long, nb long")
    got = {r["word"]: r["canon"] for r in usual_spelling(near, 10).collect()}
    assert got == {"ana": "ann", "anna": "anna"}


@pytest.mark.parametrize(
    "name, kind, given, family",
    [
        ("  José   Trellelin ", "person", "jose", "trellelin"), ("TRELLELIN, JOSÉ", "person", "jose", "trellelin"), ("Dr. Rick Cudiluvez", "person", "richard", "cudiluvez"), ("Beatriz V.", "person", "beatriz", "v"),
        ("n/a", "standin", None, None), ("", "none", None, None), (None, "none", None, None), ("a@b.example", "email", None, None), ("Felineby Mgmt Group", "org", "#group management", "felineby"),
        ("Ana", "person", "ana", None), ("…", "standin", None, None),
    ],
)
def test_parse_name(name, kind, given, family):
    assert parse_name(name)[:3] == (kind, given, family)


def test_contacts(spark):
    rows = [(" A.B+x@Mail.Example\n", "(928) 143-5967 x12"), ("a@b", "143-5967"), ("none@none.example", "555 555 5555"), ("x,y@mail.example", None), (None, "")]
    df = spark.createDataFrame(rows, "e string, p string")
    got = [tuple(r) for r in df.select(usable_email(F.col("e")), usable_phone(F.col("p")), kept_email(F.col("e"))).collect()]
    assert [g[0] for g in got] == ["a.b@mail.example", None, None, "x.y@mail.example", None]
    assert [g[1] for g in got] == ["9281435967", None, None, None, None]
    assert got[0][2] == rows[0][0] and got[1][2] is None and got[2][2] is None


PEOPLE = "name string, email string, phone string, pid string, tag string, entity string"


def people(spark, *rows):
    return spark.createDataFrame([(*r, "kept", "clash") for r in rows], PEOPLE)


FOLK = [
    ("Martha Bruveruwick", "martha.bruveruwick@mail.example", None, "1"), ("Bruveruwick, Martha", None, "201 555 1234", "1"), ("Martha Bruverwick", None, None, None), ("M. Bruveruwick", "martha.bruveruwick@mail.example", None, None),
    ("Peter Bruveruwick", "martha.bruveruwick@mail.example", "201 555 1234", None), ("n/a", "martha.bruveruwick@mail.example", None, None), (None, None, None, None), ("Guest", None, None, None),
    ("Oscar Lind", "oscar.lind11@mail.example", None, "7"), ("Oscar Lind", "oscar.lind99@mail.example", None, "8"), ("x" * 3000, None, None, None), ("", "", "", ""),
] + [("Martha Solander", f"m{i}@mail.example", None, None) for i in range(3)] + [("Bruveruwick Martha", None, None, None)]


def test_identify_edges(spark):
    out = identify(people(spark, *FOLK, *FOLK))
    assert out.count() == 2 * len(FOLK) and "tag" in out.columns
    who = {(r["name"], r["email"], r["pid"]): r["entity"] for r in out.collect()}
    assert who[(None, None, None)] is None
    martha = who[("Martha Bruveruwick", "martha.bruveruwick@mail.example", "1")]
    assert martha == who[("Bruveruwick, Martha", None, "1")] == who[("M. Bruveruwick", "martha.bruveruwick@mail.example", None)]
    assert who[("Peter Bruveruwick", "martha.bruveruwick@mail.example", None)] != martha
    # Namesakes with two ids and two mailboxes of their own.
    assert who[("Oscar Lind", "oscar.lind11@mail.example", "7")] != who[("Oscar Lind", "oscar.lind99@mail.example", "8")]
    assert identify(people(spark).limit(0)).count() == 0


def test_variants_come_from_the_tries(spark, monkeypatch):
    df = people(spark, *FOLK, *FOLK)
    got = {(r["name_a"], r["name_b"]) for r in name_variants(df).collect()}
    same = ["Bruveruwick Martha", "Bruveruwick, Martha", "M. Bruveruwick", "Martha Bruveruwick", "Martha Bruverwick"]
    assert got == {(a, b) for a in same for b in same if a < b}
    classes = [tuple(r) for r in name_classes(df).select("spelling", "name").where("name <> spelling").collect()]
    assert sorted(classes) == [(same[0], n) for n in same[1:]]

    def no_pairs(parts):
        import pandas as pd

        for _ in parts:
            yield pd.DataFrame({"tag": [], "a": [], "b": []}).astype(str)

    monkeypatch.setattr("tallyweave.llm.spelling._join_shards", no_pairs)
    assert name_variants(df).count() == 0


def test_survivors_against_sorting(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["g1", "g2", "g3", None]), f"r{i:02d}", rng.choice(["v", None]), rng.choice([1, 2, None]), rng.choice([10, 20, None])) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:5], "grp string, rid string, val string, trust int, seen int").withColumn("lo", F.lit(1))
    got = {(r["group_id"], r["field_name"]): r["source_id"] for r in survivors(df, "grp", "rid", {"f": (F.col("val"), [F.col("trust"), -F.col("seen")])}).collect()}
    want = {}
    for g in ("g1", "g2", "g3"):
        own = [r for r in rows if r[0] == g]
        if len(own) > 1 and any(r[2] for r in own):
            last = lambda x: (x is None, x)
            best = min((r for r in own if r[2]), key=lambda r: (last(r[3]), (r[4] is None, -(r[4] or 0)), r[1]))
            want[min(r[1] for r in own), "f"] = best[1]
    assert got == want
    assert survivors(df.limit(0), "grp", "rid", {"f": (F.col("val"), [F.col("trust")])}).count() == 0


def bm25(docs):
    df = {}
    for d in docs.values():
        for t in d:
            df[t] = df.get(t, 0) + 1
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    idf = {t: math.log1p((n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    sat = {d: (K1 + 1) / (1 + K1 * (1 - B + B * len(ts) / avg)) for d, ts in docs.items()}
    return idf, sat


def test_retrieval_against_all_pairs(spark):
    rng = random.Random(9)
    docs = {(f"t{i % 3}", f"d{i}"): {f"k{min(int(rng.expovariate(0.12)), 40)}" for _ in range(rng.randint(1, 6))} | ({"hot"} if i % 3 else set()) for i in range(60)}
    rows = [(tab, d, None, t, 1) for (tab, d), ts in docs.items() for t in ts]
    df = spark.createDataFrame(rows, "tab string, doc string, name string, token string, tf int")
    got = {(r["tab_x"], r["x"], r["tab_y"], r["rank"]): (r["y"], round(r["score"], 9)) for r in retrieve(df).collect()}
    idf, sat = bm25(docs)
    want = {}
    for (tab, x), ts in docs.items():
        own = sum(idf[t] for t in ts) * sat[tab, x]
        for other in {t for t, _ in docs} - {tab}:
            near = sorted((-sum(idf[t] for t in ts & us) * sat[other, y], y) for (tb, y), us in docs.items() if tb == other and ts & us)
            for k, (s, y) in enumerate([p for p in near if -p[0] >= LEAST * own][:2], 1):
                want[tab, x, other, k] = (y, round(-s, 9))
    assert got == want and len(got) > 50
    pairs = {(r["x"], r["y"]) for r in mutual_nearest(retrieve(df)).collect()}
    assert pairs == {(x, y) for (tab, x, other, k), (y, _) in want.items() if k == 1 and tab < other and want.get((other, y, tab, 1), ("",))[0] == x}


def test_logistic():
    a, b = fit_logistic([(i / 100, float(i > 40)) for i in range(100)])
    curve = lambda g: 1 / (1 + math.exp(-a - b * g))
    assert curve(0.9) > 0.9 and curve(0.1) < 0.1
    assert all(map(math.isfinite, fit_logistic([]) + fit_logistic([(0.5, 1.0)] * 5)))


def test_matching_edges(spark):
    cols = "tab string, id string, name string, email string, phone string, pid string, takes_part boolean, doc string"
    rows = [(t, f"{t[0]}{i}", f"Name{chr(97 + i)} Family{chr(97 + i) * 3}", f"box{chr(97 + i)}@mail.example", None, None, True, "clash") for i in range(8) for t in ("ghl_opportunities", "meta_leads")]
    rows += [("meta_leads", "m0", "Namea Familyaaa", None, "0000000000", None, True, "x"), ("meta_leads", None, None, None, None, None, None, None), rows[0]]
    got = {(r["id_a"], r["id_b"]) for r in match_entities(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(f"g{i}", f"m{i}") for i in range(8)}
    assert match_entities(spark.createDataFrame([], cols)).count() == 0


def test_strings_two_edits_apart_meet(spark):
    rng = random.Random(3)
    rows = []
    for n in [*range(9), *range(WHOLE - 3, WHOLE + 4), 80]:
        for _ in range(12):
            a = "".join(rng.choice("abé") for _ in range(n))
            b = a
            for _ in range(2):
                k = rng.randrange(len(b) + 1)
                b = rng.choice([b[:k] + "c" + b[k:], b[:k] + b[k + 1 :], b[:k] + "d" + b[k + 1 :]])
            rows.append((a, b))
    met = spark.createDataFrame(rows, "a string, b string").withColumn("met", F.arrays_overlap(_two_edits(F.col("a")), _two_edits(F.col("b"))))
    assert met.where("levenshtein(a, b) <= 2 AND NOT met").count() == 0
    assert met.where("levenshtein(a, b) <= 2").count() == len(rows)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_contradicted_against_all_values(spark):
    rng = random.Random(11)
    pools = {"pattern": ["g/./mail", "f/_/7", "g//9", "f/-/1"], "box": ["ana.lind", "ana.lint", "lind_ana7", "bo" * 20, "bo" * 20 + "x", "q1", "zzz99"], "local": ["1435967", "1435976", "5550101", "9998887"]}
    docs = {(t, f"d{i}"): {k: {v for v in pool if rng.random() < 0.25} for k, pool in pools.items()} for t in "ab" for i in range(16)}
    docs["a", "d0"]["box"] = {f"first{i}" for i in range(120)}
    docs["b", "d0"]["box"] = {f"other-{i}" for i in range(150)}
    docs["b", "d1"]["box"] = {f"other-{i}" for i in range(150)} | {"first5@"}
    marks = [(t, d, k, v) for (t, d), kinds in docs.items() for k, vs in kinds.items() for v in [*vs, None]] * 2
    pairs = [("a", x, "b", y) for (t, x), (u, y) in itertools.product(docs, docs) if (t, u) == ("a", "b")]

    def apart(x, y):
        both = lambda k: x[k] and y[k]
        near = lambda k: any(lev(a, b) <= 2 for a in x[k] for b in y[k])
        mailboxes = both("pattern") and not x["pattern"] & y["pattern"] and not near("box") and not x["local"] & y["local"]
        return bool(mailboxes or both("local") and not near("local") and both("box") and not near("box"))

    want = {p for p in pairs if apart(docs[p[:2]], docs[p[2:]])}
    got = {tuple(r) for r in contradicted(spark.createDataFrame(pairs, "tab_x string, x string, tab_y string, y string"), spark.createDataFrame(marks, "tab string, doc string, kind string, v string")).collect()}
    assert got == want and 20 < len(want) < len(pairs) - 20


def test_many_addresses_are_checked(spark):
    """Twenty people of one table answer the same 120 mailboxes and numbers; two more are in another table under a name of theirs."""
    cols = "tab string, id string, name string, email string, phone string, pid string, takes_part boolean"
    many = [("Martha", "Solander"), ("Otto", "Brixelway"), *[(f"{chr(97 + i) * 3}ulian", f"{chr(122 - i) * 3}etterick") for i in range(18)]]
    rows = [("ghl_opportunities", f"g{i}-{j}", f"{g} {f}", f"desk{j * 7919:06d}x@mail.example", f"{4000000 + j * 10007}", None, True) for i, (g, f) in enumerate(many) for j in range(60)]
    rows += [("ghl_opportunities", f"g{i}-own", f"{g} {f}", f"{g}.{f}@mail.example".lower(), None, None, True) for i, (g, f) in enumerate(many)]
    rows += [("meta_leads", "m0", "Martha Solander", "solander_martha77@post.example", None, None, True), ("meta_leads", "m1", "Otto Brixelway", "otto.brixelway@mail.example", None, None, True)]
    got = {(r["id_a"], r["id_b"]) for r in match_entities(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(f"g1-{j}", "m1") for j in [*range(60), "own"]}
