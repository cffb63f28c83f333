"""p6, p7 and p8: passages of items, mixtures by source, stuffed texts."""

import itertools
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyweave.llm.mixture import fill, knapsack, mixture
from tallyweave.llm.passages import Finder, held_items
from tallyweave.llm.stuffed import stuffed_documents, stuffed_share
from tallyweave.llm.words import words

ITEM = (
    "When a roof fire closed the quarry shed, 24 families from Selwick gave away their prayer ribbons beside Ilvane the loom weaver. "
    "Only Wilhemine knew that the mill loft of Kelvane held 568 wool blankets, which the tax rider had ruined by Epiphany."
)
OTHER = "Bartho owed the clock mender 153 coins, divided sailcloth rolls in Holdal, and blamed a spring flood near the lower ferry dock."
PROSE = "The widow down the street waited years for a second chance, and nobody in that village could explain the road back. "


def test_registered():
    assert {"p6_found", "p7_mixture", "p7_shares", "p8_found"} <= set(entry.queries())


def test_passages_however_set_down():
    f = Finder([(1, ITEM), (2, OTHER)])
    w = ITEM.split()
    assert f.found(PROSE + ITEM + PROSE) == [1]
    assert f.found(PROSE + " ".join(w[5:23]) + " " + PROSE) == [1]
    assert f.found(PROSE + " ".join(w[5:19]) + " " + PROSE) == []
    assert f.found(ITEM.upper().replace("LOOM", "lo­om").replace("MILL", "<b>mi1l</b>").replace(" OF ", "\n> of ")) == [1]
    assert f.found(ITEM.replace("closed", "many").replace("Only", "near").replace("568", "old")) == [1]
    story = ITEM.replace("Selwick", "Ostbury").replace("24", "31").replace("Ilvane the loom weaver", "Dessily the harbor keeper").replace("prayer ribbons", "oak barrels")
    story = story.replace("Wilhemine", "Corwyth").replace("mill loft of Kelvane", "bakery attic of Marmora").replace("568 wool blankets", "449 silver buttons").replace("tax rider", "hard frost")
    assert f.found(story) == []
    assert f.found(None) == [] and f.found("") == []


def test_held_items(spark):
    docs = spark.createDataFrame([(1, PROSE + OTHER), (2, PROSE), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, OTHER), (7, OTHER), (8, None)], "item_id bigint, text string")
    assert [tuple(r) for r in held_items(docs, items).collect()] == [(1, 7)]


def test_stuffed(spark):
    words = "bulk car wash, cheap car wash, car wash near me, white bible covers, bible covers sale, car wash top, "
    links = " ".join(f'<a href="https://shop{i % 3}.test/{i}">cheap mugs</a>' for i in range(30))
    wares = "\n".join(f"herbal tea S USD {i}.19 SKU{i}2303 add to cart" for i in range(30))
    rota = "\n".join(f"Sun {i + 1} 10:30 Kitchen: Anna Berg{i}, Paul Lind{i}" for i in range(20))
    good = [PROSE * 4, PROSE * 5 + "https://visit.house.example/1 #hope $5", rota, "", None]
    assert all(stuffed_share(t) > 0.5 for t in (words * 8, links, wares, PROSE + words * 12))
    rows = list(enumerate([words * 8, links, wares, *good]))
    got = stuffed_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2}


def test_knapsack_against_all_subsets():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        budget = rng.randint(0, 120)
        best = max(s for ks in itertools.product(*(range(k + 1) for k in counts.values())) if (s := sum(n * k for n, k in zip(counts, ks))) <= budget)
        for got in (knapsack(counts, budget), fill(counts, budget)):
            assert all(0 <= k <= counts[n] for n, k in got.items())
            assert sum(n * k for n, k in got.items()) == best
    assert knapsack({}, 5) == {} and fill({}, 5) == {}
    big = fill({n: 1000 for n in range(5, 400)}, 30_000_001)
    assert sum(n * k for n, k in big.items()) == 30_000_001


def test_mixture(spark):
    rows = [(i, f"w{i} " * (10 + i % 7), "a" if i % 2 else " B ") for i in range(1, 60)] + [(90, "x", "other"), (91, None, "a"), (92, "w1 " * 11, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.65, 3), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    parts, shares = mixture(docs, targets)
    most = {"a": 1, "b": 3}
    assert all(1 <= r["repeats"] <= most[r["source"]] for r in parts.collect())
    got = {r["source"]: r for r in shares.collect()}
    assert got["c"]["tokens"] == 0 and abs(got["a"]["actual_share"] - 0.25 / 0.9) < 0.005 and abs(got["b"]["actual_share"] - 0.65 / 0.9) < 0.005


def test_rows_that_break_things(spark):
    """NULL ids and texts, empty and very long texts, repeated rows, clashing columns, empty tables."""
    long = PROSE * 400 + OTHER
    rows = [(1, long, "a", "x"), (1, long, "a", "x"), (None, OTHER, "a", "x"), (2, None, None, None), (3, "", "a", "x"), (4, "​ \n", "A ", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, item_id string").withColumn("tokens", F.lit("clash")).withColumn("share", F.lit("clash"))
    items = spark.createDataFrame([(7, OTHER, 9), (None, ITEM, 9), (8, "", 9)], "item_id bigint, text string, doc_id int")
    assert [tuple(r) for r in held_items(docs, items).collect()] == [(1, 7), (1, 7)]
    assert held_items(docs, items.limit(0)).count() == 0 and held_items(docs.limit(0), items).count() == 0
    assert stuffed_documents(docs).count() == 0 and stuffed_documents(docs.limit(0)).count() == 0
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1), ("b", None, 1), ("c", 0.0, 3)], "source string, target_share double, max_repeats int")
    parts, shares = mixture(docs, targets)
    assert sorted((r["doc_id"], r["repeats"]) for r in parts.collect()) == [(1, 2), (4, 2)]
    assert {r["source"]: round(r["actual_share"], 6) for r in shares.collect()} == {"a": 1.0, None: 0.0, "b": 0.0, "c": 0.0}
    assert mixture(docs.limit(0), targets)[0].count() == 0 and mixture(docs, targets.limit(0))[1].count() == 0


def test_pruning_loses_no_passage():
    """The vectorised bound against the plain walk over texts stitched from pieces of items, altered here and there."""
    rng = random.Random(11)
    items = [(k, " ".join(rng.sample((ITEM + " " + OTHER + " " + PROSE).split(), 40))) for k in range(12)] + [(20, ITEM), (21, OTHER)]
    f = Finder(items)
    texts = []
    for _ in range(250):
        out = []
        for _ in range(rng.randint(1, 6)):
            w = dict(items)[rng.choice(items)[0]].split()
            a = rng.randrange(len(w))
            piece = w[a : a + rng.randint(3, 30)]
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(piece))
                piece[k : k + 1] = rng.choice([[], ["zzz"], [piece[k], "um"]]) or [piece[k]]
            out += piece + rng.choice([[], PROSE.split()[: rng.randint(1, 9)]])
        texts.append(" ".join(out))
    plain = [f._streamed(words(t)) for t in texts]
    assert f.found_in(texts) == plain and sum(map(bool, plain)) > 20
