"""p5: increments one after another give what one bulk increment gives; deletions reopen."""

import datetime as dt

from tallyweave.operators.orphans import advance, empty_index, empty_state, problems

REFS = "ref_table string, record_id string, target string, key string, ref_at timestamp_ntz"
PARENTS = "target string, key string, since timestamp_ntz"


def day(n):
    return dt.datetime(2025, 1, n)


def test_increments(spark):
    refs = lambda *rows: spark.createDataFrame([("t", r, "p", k, day(n)) for r, k, n in rows], REFS)
    parents = lambda *rows: spark.createDataFrame([("p", k, day(n)) for k, n in rows], PARENTS)
    got = lambda s: sorted((r["record_id"], r["problem"]) for r in problems(s).collect())
    first = refs(("r1", "a", 5), ("r2", "b", 5), ("r3", "c", 5))
    state, index = advance(empty_state(spark), empty_index(spark), first, parents(("a", 9), ("b", 2)))
    assert got(state) == [("r1", "late"), ("r3", "absent")]
    # An earlier version of parent a; r2 sent again, before its parent; parent c at last.
    state, index = advance(state, index, refs(("r2", "b", 1), ("r4", "d", 5)), parents(("a", 3), ("c", 7)))
    assert got(state) == [("r2", "late"), ("r3", "late"), ("r4", "absent")]
    assert state.count() == 4
    bulk, _ = advance(empty_state(spark), empty_index(spark), first.union(refs(("r2", "b", 1), ("r4", "d", 5))), parents(("a", 9), ("b", 2), ("a", 3), ("c", 7)))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, bulk.select(*state.columns).collect()))
    gone = spark.createDataFrame([("p", "a")], "target string, key string")
    state, index = advance(state, index, refs(), parents(), gone)
    assert got(state) == [("r1", "absent"), ("r2", "late"), ("r3", "late"), ("r4", "absent")]
