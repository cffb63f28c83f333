"""Text search: words with weights by field, queries as people type them, a rank."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: words that tell nothing, of the English search configuration.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Weights of the classes A, B, C and D.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def stem(w: Column) -> Column:
    """Plural and participle endings off: ``ies`` to ``y``, ``es`` after a hiss, ``s``, ``ing``, ``ed``."""
    w = F.regexp_replace(w, r"^(.{2,})ies$", "$1y")
    w = F.regexp_replace(w, r"^(.*(?:s|x|z|ch|sh))es$", "$1")
    return F.regexp_replace(F.regexp_replace(w, r"^(.+[^s])s$", "$1"), r"^(.{3,})(?:ing|ed)$", "$1")


def search_words(c: Column) -> Column:
    """Stemmed words in order, without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\p{N}+)"), 1)
    return F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), stem)


def search_index(docs: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """``key, word, weight``: postings of all words, summed over fields by the weight class of each (``fields``: column to class)."""
    def weighted(c: str, k: str) -> Column:
        return F.transform(F.coalesce(search_words(F.col(c)), F.array().cast("array<string>")), lambda w: F.struct(w.alias("word"), F.lit(WEIGHTS[k]).alias("weight")))

    posts = F.explode(F.flatten(F.array(*[weighted(c, k) for c, k in fields.items()]))).alias("p")
    return docs.select(key, posts).groupBy(key, "p.word").agg(F.sum("p.weight").alias("weight"))


def parsed_query(query: str) -> tuple[list[list[tuple[str, ...]]], list[tuple[str, ...]]]:
    """``(all of these, none of these)`` of a query as typed on the web.

    Words are all needed; ``or`` between two makes alternatives; ``"a b"`` is a phrase; ``-`` bans.
    """
    need: list[list[tuple[str, ...]]] = []
    ban: list[tuple[str, ...]] = []
    either = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            either = bool(need)
            continue
        term = tuple(w for w in re.findall(r"[^\W_]+", (phrase or word).lower()) if w not in STOP_WORDS)
        if not term:
            continue
        if minus:
            ban.append(term)
        elif either:
            need[-1].append(term)
        else:
            need.append([term])
        either = False
    return need, ban


def search(docs: DataFrame, key: str, fields: Mapping[str, str], query: str) -> DataFrame:
    """``key, rank`` of the documents a query fits, one pass over the table, no join.

    The rank is the sum over fields of the weight of each field times ``ln(1 + n)`` of how often the
    needed words stand in it. A query without a word fits nothing.
    """
    need, ban = parsed_query(query)
    if not need:
        return docs.select(key, F.lit(0.0).alias("rank")).where("false")
    # Only words that begin as a query word does are looked at; just rows that have those of a phrase are read word by word.
    lower = docs.select(key, *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fields])

    def times(c: str, w: str) -> Column:
        begins = F.regexp_extract_all(F.col(c), F.lit(rf"(?<![\p{{L}}\p{{N}}])({re.escape(_beginning(w))}[\p{{L}}\p{{N}}]*)"), 1)
        return F.size(F.filter(begins, lambda x: stem(x) == stem(F.lit(w))))

    def holds(term: tuple[str, ...]) -> Column:
        single = _any([F.contains(F.col(c), F.lit(_beginning(term[0]))) & (times(c, term[0]) > 0) for c in fields])
        if len(term) == 1:
            return single
        said = F.concat(F.lit(" "), F.array_join(F.transform(F.array(*[F.lit(w) for w in term]), stem), " "), F.lit(" "))
        return single & _any([F.contains(F.concat(F.lit(" "), F.array_join(search_words(F.col(c)), " "), F.lit(" ")), said) for c in fields])

    fits = F.lit(True)
    for options in need:
        fits = fits & _any([holds(t) for t in options])
    for t in ban:
        fits = fits & ~holds(t)
    rank = F.lit(0.0)
    for c, k in fields.items():
        rank = rank + F.lit(WEIGHTS[k]) * F.log1p(sum((times(c, w) for o in need for t in o for w in t), F.lit(0)))
    return lower.where(fits).select(key, rank.alias("rank"))


def _beginning(w: str) -> str:
    """What every word of the same stem begins with."""
    w = re.sub(r"^(.{2,})ies$", r"\1", w)
    w = re.sub(r"^(.*(?:s|x|z|ch|sh))es$|^(.+[^s])s$", lambda m: m[1] or m[2], w)
    w = re.sub(r"^(.{3,})(?:ing|ed)$", r"\1", w)
    return w[:-1] if len(w) > 2 and w.endswith("y") else w


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
