"""Matching entities across tables that share no key: BM25 retrieval, mutual nearest, confidence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stable
from .people import identify, own_contact

#: BM25's saturation of repeated tokens and its length norm.
K1, B = 1.2, 0.75
#: Least share of a document's own score that a match must reach: below it, two documents are no candidates at all.
LEAST = 0.15
#: Mailboxes up to so many letters are looked up whole when two edits are allowed for, longer ones by both ends.
WHOLE = 32
#: Most labelled pairs the calibration is fitted on.
CALIBRATION_PAIRS = 20_000
#: What names a pair of documents.
PAIR = ["tab_x", "x", "tab_y", "y"]


def retrieve(tokens: DataFrame, k: int = 2) -> DataFrame:
    """Top ``k`` documents of each other table for each document, by BM25 over an inverted index.

    ``tokens (tab, doc, name, token, tf)`` are the documents' attributes; ``name`` is the full name
    of the document or NULL. Returns ``tab_x, x, tab_y, y, score, rank``: ``y`` is the ``rank``-th
    nearest of ``x`` in ``tab_y``, ties by ``y``. Documents of two different full names are checked
    off before the ranking: they share a household's contacts and are no rivals.

    A match must reach the share ``LEAST`` of the score that ``x`` has with itself. So pruning is
    exact: of the tokens of ``x`` in order of their greatest possible weight, those that together
    stay under that share can lift no document over it, and only the rest look into the index. A
    token that a third of all documents hold weighs next to nothing and is looked up only by
    documents that have little else. Scores of the candidates are then completed over all tokens.
    """
    held = tokens.groupBy("tab", "doc", "name", "token").agg(F.sum("tf").alias("tf"))
    size = held.groupBy("tab", "doc").agg(F.sum("tf").alias("len"))
    n, avg = size.agg(F.count(F.lit(1)), F.avg("len")).first()
    df = held.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    sat = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg or 1.0)))
    held = held.join(size, ["tab", "doc"]).join(df, "token").select("tab", "doc", "name", "token", (idf * sat).alias("w"), (idf * (K1 + 1)).alias("most"))
    # Tokens of a document with equal weight stand together, so what is put in order is no longer than the list of weights.
    upto = F.sum("sum").over(Window.partitionBy("tab", "doc").orderBy("most").rowsBetween(Window.unboundedPreceding, 0))
    steps = held.groupBy("tab", "doc", "most").agg(F.sum("most").alias("sum")).select("tab", "doc", "most", upto.alias("upto"))
    own = held.groupBy("tab", "doc").agg(F.sum("w").alias("own"))
    held = held.join(steps, ["tab", "doc", "most"]).join(own, ["tab", "doc"])
    held = stable(held.select("tab", "doc", "name", "token", "w", "own", (F.col("upto") >= LEAST * F.col("own")).alias("telling")))
    x = held.select(F.col("tab").alias("tab_x"), F.col("doc").alias("x"), "token", F.col("own").alias("own_x"), "telling", F.col("name").alias("name_x"))
    y = held.select(F.col("tab").alias("tab_y"), F.col("doc").alias("y"), "token", "w", F.col("name").alias("name_y"))
    differ = F.coalesce(F.col("name_x") != F.col("name_y"), F.lit(False))
    cand = x.where("telling").join(y, "token").where(F.col("tab_x") != F.col("tab_y")).where(~differ).select("tab_x", "x", "tab_y", "y").distinct()
    scored = (
        cand.join(x.select("tab_x", "x", "token", "own_x"), ["tab_x", "x"]).join(y, ["tab_y", "y", "token"])
        .groupBy("tab_x", "x", "tab_y", "y").agg(F.sum("w").alias("score"), F.first("own_x").alias("own_x"))
        .where(F.col("score") >= LEAST * F.col("own_x"))
    )
    best = Window.partitionBy("tab_x", "x", "tab_y").orderBy(F.desc("score"), "y")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("tab_x", "x", "tab_y", "y", "score", "rank")


def mutual_nearest(near: DataFrame) -> DataFrame:
    """``tab_x < tab_y, x, y, score, gap``: documents that are each other's nearest.

    ``gap`` is how far the next rival of either side is behind, as a share of the score.
    """
    key = ["tab_x", "x", "tab_y"]
    second = near.where("rank = 2").select(*key, F.col("score").alias("next"))
    first = near.where("rank = 1").join(second, key, "left").select(*key, "y", "score", (1 - F.coalesce(F.col("next"), F.lit(0.0)) / F.col("score")).alias("gap"))
    back = first.select(F.col("tab_x").alias("tab_y"), F.col("x").alias("y"), F.col("tab_y").alias("tab_x"), F.col("y").alias("x"), F.col("score").alias("score_y"), F.col("gap").alias("gap_y"))
    both = first.where("tab_x < tab_y").join(back, ["tab_x", "x", "tab_y", "y"])
    return both.select("tab_x", "x", "tab_y", "y", F.least("score", "score_y").alias("score"), F.least("gap", "gap_y").alias("gap"))


def fit_logistic(rows: list[tuple[float, float]]) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps; a slight prior holds it where labels are few or all alike."""
    rows = [*rows, (0.0, 0.0), (1.0, 1.0)]
    x, y = (np.array(c, dtype=float) for c in zip(*rows))
    a, beta = np.c_[np.ones(len(x)), x], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def calibrate(tokens: DataFrame) -> tuple[float, float]:
    """The curve from score gap to confidence, fitted on pairs whose truth their phones tell.

    Retrieval is run on the documents that have a phone, without their phones; a mutual pair is then
    a case if the phones agree. What the curve is fitted on is thus held back from what it scores.
    At most ``CALIBRATION_PAIRS`` pairs, picked by hash, are fitted; the curve serves all.
    """
    phone = F.substring("token", 1, 2).isin("p:", "l:")
    phones = tokens.where(phone).select("tab", "doc", "token")
    blind = tokens.where(~phone).join(phones.select("tab", "doc").distinct(), ["tab", "doc"], "left_semi")
    pairs = stable(mutual_nearest(retrieve(blind)).select("tab_x", "x", "tab_y", "y", "gap"))
    side = lambda t, d: phones.select(F.col("tab").alias(t), F.col("doc").alias(d), "token")
    key = ["tab_x", "x", "tab_y", "y"]
    agree = pairs.join(side("tab_x", "x"), ["tab_x", "x"]).join(side("tab_y", "y"), ["tab_y", "y", "token"]).select(*key).distinct().withColumn("label", F.lit(1.0))
    rows = pairs.join(agree, key, "left").select("gap", F.coalesce("label", F.lit(0.0)).alias("label"), F.xxhash64(*key).alias("h"))
    return fit_logistic([(r["gap"], r["label"]) for r in rows.orderBy("h").limit(CALIBRATION_PAIRS).collect()])


#: The attributes of a record by the tag of their tokens.
_FIELDS = {"e": "e", "b": "box", "p": "p", "l": "s", "n": "name_key", "f": "family"}


def _attributes() -> Column:
    return F.explode(F.array_compact(F.array(*[F.concat(F.lit(tag + ":"), F.col(c)) for tag, c in _FIELDS.items()]))).alias("token")


def _sides(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``marks`` beside each pair, ``side`` 0 those of ``x`` and 1 those of ``y``."""
    side = lambda t, d, n: pairs.select(*PAIR).join(marks.select(F.col("tab").alias(t), F.col("doc").alias(d), "kind", "v"), [t, d]).select(*PAIR, "kind", "v", F.lit(n).alias("side"))
    return side("tab_x", "x", 0).unionByName(side("tab_y", "y", 1))


def _two_edits(v: Column) -> Column:
    """Hashes of which two strings at most two edits apart have one in common, whatever their lengths.

    Up to ``WHOLE`` letters, what is left of a string without any two letters at most: two edits are
    undone by two deletions on each side. Of two longer strings (or one of them a letter or two
    shorter) at most one edit is in the first letters, so that these meet without a letter, or both
    are, and the last letters are the same. Strings that are further apart may meet, too.
    """
    less = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.left(c, i - 1), F.substr(c, i + 1)))
    one = lambda c: F.when(F.length(c) > 0, F.concat(F.array(c), less(c))).otherwise(F.array(c))
    end = (WHOLE - 1) // 2
    whole = F.when(F.length(v) <= WHOLE, F.flatten(F.transform(one(v), one)))
    ends = F.when(F.length(v) >= WHOLE - 1, F.concat(F.transform(one(F.left(v, F.lit(end))), lambda c: F.concat(F.lit("<"), c)), F.array(F.concat(F.lit(">"), F.right(v, F.lit(end))))))
    return F.array_distinct(F.transform(F.flatten(F.array_compact(F.array(whole, ends))), lambda c: F.xxhash64(c)))


def _near(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """``tab_x, x, tab_y, y, kind`` where a value of one side is at most two edits from one of the other."""
    rows = _sides(pairs, marks).withColumn("h", F.explode(_two_edits(F.col("v"))))
    side = lambda n: rows.where(F.col("side") == n).select(*PAIR, "kind", "h", F.col("v").alias(f"v{n}"))
    return side(0).join(side(1), [*PAIR, "kind", "h"]).where(F.levenshtein("v0", "v1", 2) >= 0).select(*PAIR, "kind").distinct()


def contradicted(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """``tab_x, x, tab_y, y`` of the pairs whose documents speak of two people.

    ``marks (tab, doc, kind, v)`` are the documents' values of the kinds pattern, box and local. A
    pair is contradicted if no mailbox of one is within two edits of one of the other and either both
    spell their names in mailboxes, never alike, and share no local number, or both have local
    numbers and mailboxes and no numbers within two edits. Values are rows, never sets in one row,
    so a document may have any number of them; only pairs that equal values leave open are compared by letters.
    """
    marks = marks.where(F.col("v").isNotNull()).distinct()
    each = _sides(pairs, marks).groupBy(*PAIR, "kind", "v").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    of = lambda k, c: F.when(F.col("kind") == k, c)
    kinds = ("pattern", "box", "local")
    both = [F.coalesce(F.min(of(k, F.col("lo"))) < F.max(of(k, F.col("hi"))), F.lit(False)).alias(f"both_{k}") for k in kinds]
    same = [F.coalesce(F.max(of(k, F.col("lo") < F.col("hi"))), F.lit(False)).alias(f"same_{k}") for k in kinds]
    told = each.groupBy(*PAIR).agg(*both, *same).where("NOT same_box AND NOT same_local").select(*PAIR, F.expr("both_pattern AND NOT same_pattern").alias("mailboxes"), F.expr("both_local AND both_box").alias("phones"))
    told = stable(told.where("mailboxes OR phones"))
    near = _near(told, marks.where("kind <> 'pattern'")).groupBy(*PAIR).agg(F.max(F.col("kind") == "box").alias("box"), F.max(F.col("kind") == "local").alias("local"))
    return told.join(near, PAIR, "left").where("NOT coalesce(box, false) AND (mailboxes OR NOT coalesce(local, false))").select(*PAIR)


def match_documents(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: matched documents of two tables, and the records of each document.

    ``records``: ``tab, id, name, email, phone, pid`` and ``takes_part`` (a record that only lends
    spellings and evidence has false). ``pairs`` has ``table_a < table_b, doc_a, doc_b, score,
    confidence``, ``members`` has ``tab, doc, id``.

    The records of one person within one table are a document, made in each table by itself. All its
    attributes, e-mail, mailbox, phone, local number, name and family, go into one inverted index. Two
    documents match if each is the other's nearest in its table, with a confidence from the gap to
    the next rival. An exact check drops pairs whose full names differ. Pairs of a confidence of at
    least 0.5 are returned; ties have no gap. Records without an e-mail or phone of their own (blank
    or stand-in) take no part; a local number is one. Empty tables give no pairs.
    """
    who = identify(records, within="tab")
    part = stable(who.where(F.col("takes_part") & own_contact(F.col("email"), F.col("phone")) & F.col("entity").isNotNull()).select("tab", F.unhex(F.md5("entity")).alias("doc"), "id", "given", "family", "e", "p", "s", "pattern"))
    rows = part.withColumns({"box": F.substring_index("e", "@", 1), "name_key": F.when(F.col("given").isNotNull(), F.concat_ws("|", "given", "family"))})
    # All records of a document have its key, so its name is that of any of them. Documents and names travel as hashes, of 128 bits where they are identities.
    tokens = rows.select("tab", "doc", F.when(F.col("name_key").isNotNull(), F.xxhash64("name_key")).alias("name"), *_FIELDS.values()).select("tab", "doc", "name", _attributes()).distinct()
    tokens = stable(tokens.withColumn("tf", F.lit(1)))
    a, b = calibrate(tokens)
    sure = stable(mutual_nearest(retrieve(tokens)).withColumn("confidence", 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("gap"))))).where("confidence >= 0.5"))
    held = {"pattern": F.col("pattern"), "box": F.substring_index("e", "@", 1), "local": F.col("s")}
    marks = part.select("tab", "doc", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("v")) for k, c in held.items()])).alias("m")).select("tab", "doc", "m.*")
    sure = sure.join(contradicted(sure, marks), PAIR, "left_anti")
    return sure.select(F.col("tab_x").alias("table_a"), F.col("x").alias("doc_a"), F.col("tab_y").alias("table_b"), F.col("y").alias("doc_b"), "score", "confidence"), part.select("tab", "doc", "id").distinct()


def match_entities(records: DataFrame) -> DataFrame:
    """Pairs of records of one person or organisation in two tables: ``match_documents`` with each document's records written out."""
    pairs, members = match_documents(records)
    of = lambda t, d, i: members.select(F.col("tab").alias(t), F.col("doc").alias(d), F.col("id").alias(i))
    return pairs.join(of("table_a", "doc_a", "id_a"), ["table_a", "doc_a"]).join(of("table_b", "doc_b", "id_b"), ["table_b", "doc_b"]).select("table_a", "id_a", "table_b", "id_b", "score", "confidence").distinct()
