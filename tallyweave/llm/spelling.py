"""Trie join: all pairs of words within one edit, found by Levenshtein automata over tries.

Of two words one edit apart (insertion, deletion, substitution or a swap of neighbours), the first
``k`` or the last ``k`` letters agree, as long as both have ``2k + 1`` letters or more. So words are
sharded by those affixes, ``k`` growing with the length of the word, each shard is a trie, and each
word of the shard is run over the trie as a bounded automaton. Nothing is compared with a word of
another shard, and within a shard only the branches within the bound are walked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shard that make one trie; a larger shard is cut into several tries and its words are run over each.
TRIE_WORDS = 20_000
#: Affix length and the word lengths it serves; neighbouring classes share a length, so a pair of lengths n and n + 1 has one.
CLASSES = ((1, 3, 7), (3, 7, 11), (5, 11, 1 << 30))


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w
    return root


def within(trie: dict, word: str, bound: int) -> list[str]:
    """Words of the trie within ``bound`` edits (adjacent swap counts one) of ``word``, itself included."""
    n, found = len(word), []
    first = list(range(n + 1))
    if "" in trie and first[n] <= bound:
        found.append(trie[""])
    stack = [(child, ch, first, None, "") for ch, child in trie.items() if ch]
    while stack:
        node, ch, row, above, before = stack.pop()
        new = [row[0] + 1]
        for i in range(1, n + 1):
            cost = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (word[i - 1] != ch))
            if above is not None and i > 1 and word[i - 1] == before and word[i - 2] == ch:
                cost = min(cost, above[i - 2] + 1)
            new.append(cost)
        if min(new) <= bound:
            if new[n] <= bound and "" in node:
                found.append(node[""])
            stack += [(child, c, new, row, ch) for c, child in node.items() if c]
    return found


def within_one(trie: dict, word: str) -> set[str]:
    """``within`` a bound of one, with the automaton's states spelled out: before the edit, and after it.

    Before the edit there is one path, the word's own; from each of its nodes every edit leads to a
    node after it, from where the rest of the word must follow letter by letter.
    """
    found: set[str] = set()
    n = len(word)

    def rest(node: dict, i: int) -> None:
        for ch in word[i:]:
            node = node.get(ch)
            if node is None:
                return
        if "" in node:
            found.add(node[""])

    node = trie
    for i in range(n + 1):
        for ch, child in node.items():
            if ch:
                rest(child, i)
                if i < n:
                    rest(child, i + 1)
        if i == n:
            rest(node, i)
            break
        rest(node, i + 1)
        if i + 1 < n and word[i + 1] in node and word[i] in node[word[i + 1]]:
            rest(node[word[i + 1]][word[i]], i + 2)
        node = node.get(word[i])
        if node is None:
            break
    return found


def _join_shards(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by tag, shard and block: build words come into the trie, query words are run over it."""
    now, build, query = None, [], []

    def done() -> pd.DataFrame:
        tag, shard, _ = now
        affix = int(shard[1])
        cut = (lambda w: w[affix:]) if shard[0] == "<" else (lambda w: w[: len(w) - affix][::-1])
        back: dict[str, list[str]] = {}
        for w in build:
            back.setdefault(cut(w), []).append(w)
        trie = _trie(list(back))
        pairs = [(tag, q, w) for q in query for hit in within_one(trie, cut(q)) for w in back[hit]]
        return pd.DataFrame(pairs, columns=["tag", "a", "b"])

    for pdf in parts:
        for tag, shard, block, role, word in zip(pdf["tag"], pdf["shard"], pdf["block"], pdf["role"], pdf["word"]):
            if (tag, shard, block) != now:
                if now is not None:
                    yield done()
                now, build, query = (tag, shard, block), [], []
            if role != "q":
                build.append(word)
            if role != "b":
                query.append(word)
    if now is not None:
        yield done()


def trie_neighbours(words: DataFrame) -> DataFrame:
    """``tag, a, b``: each word ``a`` with each word ``b`` of its tag within one edit, itself included.

    ``words`` has the string columns ``tag, word``; repeated words count once and NULLs not at all,
    other columns are ignored. Words under three letters only find themselves. Both directions of
    a pair come out. An empty table gives no rows. A shard of more than ``TRIE_WORDS`` words is
    built as several tries, so no task holds more.
    """
    words = words.select("tag", "word").where(F.col("tag").isNotNull() & F.col("word").isNotNull()).distinct()
    n = F.length("word")
    shards: list[Column] = []
    for k, low, high in CLASSES:
        fits = (n >= low) & (n <= high)
        shards += [F.when(fits, F.concat(F.lit(f"<{k}"), F.left("word", F.lit(k)))), F.when(fits, F.concat(F.lit(f">{k}"), F.right("word", F.lit(k))))]
    shards.append(F.when(n < 3, F.concat(F.lit("<0"), F.col("word"))))
    rows = words.select("tag", "word", F.explode(F.array_compact(F.array(*shards))).alias("shard"))
    size = rows.groupBy("tag", "shard").agg(F.ceil(F.count(F.lit(1)) / TRIE_WORDS).cast("int").alias("blocks"))
    home = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.join(size, ["tag", "shard"]).select("tag", "shard", "word", home.alias("home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = rows.select("tag", "shard", "block", F.when(F.col("home") == F.col("block"), "bq").otherwise("q").alias("role"), "word")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "tag", "shard", "block").sortWithinPartitions("tag", "shard", "block")
    return rows.mapInPandas(_join_shards, "tag string, a string, b string").distinct()


def ranked_neighbours(vocab: DataFrame) -> DataFrame:
    """``tag, a, b, na, nb``: the trie's neighbours with how often each is written (``vocab``: ``tag, word, n``)."""
    v = vocab.where(F.col("word").isNotNull()).groupBy("tag", "word").agg(F.sum("n").alias("n"))
    hits = trie_neighbours(v)
    return hits.join(v.select("tag", F.col("word").alias("a"), F.col("n").alias("na")), ["tag", "a"]).join(v.select("tag", F.col("word").alias("b"), F.col("n").alias("nb")), ["tag", "b"])


def usual_spelling(near: DataFrame, ratio: float) -> DataFrame:
    """``tag, word, canon, n``: of the neighbours of each word (``ranked_neighbours``) the most usual one.

    A word yields to the neighbour written most often, if that is ``ratio`` times as often as the
    word itself (ties: the smaller word), else it stays. Words the trie didn't find are not there.
    """
    yields = (F.col("a") == F.col("b")) | (F.col("nb") >= ratio * F.greatest(F.col("na"), F.lit(1)))
    return near.where(yields).groupBy("tag", F.col("a").alias("word")).agg(F.max_by(F.struct("b", "nb"), F.struct("nb", F.col("a") == F.col("b"), "b")).alias("t")).select("tag", "word", F.col("t.b").alias("canon"), F.col("t.nb").alias("n"))
