"""Mixtures of documents by source: target shares of all tokens, bounded repeats."""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import spread, stable

#: Vocabulary of a public tokenizer, as ranks; the file must be there on every worker.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one length and hash bucket that are ranked together.
BUCKET_DOCS = 100_000
SEED = 7


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, same, tokens``: tokens of each text, NULL and empty ones left out.

    ``source`` is spelled plainly, ``same`` is equal for equal texts. Texts are read whole, without a shuffle.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_ordinary
        for pdf in parts:
            yield pdf.assign(tokens=[len(encode(t)) for t in pdf["text"]]).drop(columns="text")

    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", F.lower(F.trim("source")).alias("source"), F.md5("text").alias("same"), "text")
    return spread(texts).mapInPandas(run, "doc_id bigint, source string, same string, tokens bigint")


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each size to take, at most as many as there are, so that their sum is the largest up to ``budget``.

    Dynamic programming over reachable sums; counts are split into powers of two, and each sum
    remembers the part that reached it first, which is all it takes to go back. It ends as soon as
    the budget itself is reached.
    """
    first = np.full(budget + 1, -1, dtype=np.int32)
    first[0] = 0
    parts: list[tuple[int, int]] = [(0, 0)]
    for size in sorted(counts, reverse=True):
        left, part = counts[size], 1
        while left > 0 and first[budget] < 0:
            part = min(part, left)
            step = size * part
            if step <= budget:
                new = (first[: budget + 1 - step] >= 0) & (first[step:] < 0)
                first[step:][new] = len(parts)
                parts.append((size, part))
            left, part = left - part, part * 2
    at, out = int(np.flatnonzero(first >= 0)[-1]), defaultdict(int)
    while at:
        size, part = parts[first[at]]
        out[size] += part
        at -= size * part
    return dict(out)


def fill(counts: dict[int, int], quota: int) -> dict[int, int]:
    """How many documents of each length fill a quota of tokens, missing it by as little as possible.

    The greater part is taken evenly of all lengths; what is then left, of the size of a few
    documents, is filled by the knapsack.
    """
    total = sum(n * k for n, k in counts.items())
    if quota >= total:
        return dict(counts)
    room = 8 * max(counts, default=0)
    took = {n: k * max(0, quota - room) // total for n, k in counts.items()}
    left = quota - sum(n * k for n, k in took.items())
    order = sorted((n for n in counts if counts[n] > took[n]), key=lambda n: (n * 2654435761 % (1 << 32), n))
    while left > room:
        for n in order:
            if left > room and took[n] < counts[n]:
                more = min(counts[n] - took[n], max(1, (left - room) // (n * len(order))))
                took[n] += more
                left -= n * more
    rest = {n: min(counts[n] - took[n], left // n) for n in counts if n <= left and counts[n] > took[n]}
    for n, k in knapsack(rest, left).items():
        took[n] += k
    return took


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``(parts, shares)``: how often each document is taken, and what share each source then has.

    ``documents (doc_id, text, source)``; ``targets (source, target_share, max_repeats)``, few rows.
    ``parts (doc_id, source, tokens, repeats)`` has ``repeats`` from 1 to the source's max_repeats.
    ``shares (source, target_share, documents, tokens, actual_share)`` has every target.

    Sizes are tokens of a public tokenizer. A text uploaded twice is one document (the smallest
    doc_id). The mixture is the largest that keeps the shares: the source that runs out first, all
    its documents repeated as often as allowed, sets the total. A target without documents gets 0
    and the others keep their proportions.

    Documents are counted by source and exact token length; the driver holds these counts, one a
    length, and neither documents nor texts. Each source fills its quota: so many copies of
    everything, and for the rest a number of each length (``fill``). Of each length the documents
    with the smallest seeded hashes are taken: whole hash buckets by their counts, and in the one
    bucket where the number ends by rank, so that no group is ranked in one piece.
    """
    spark = documents.sparkSession
    plain = F.lower(F.trim("source"))
    wanted = targets.select(plain.alias("source")).where(F.col("source").isNotNull()).distinct()
    one = token_counts(documents, vocabulary).join(F.broadcast(wanted), "source").groupBy("same").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d"))
    docs = stable(one.select("d.doc_id", "d.source", "d.tokens", F.xxhash64("d.doc_id", F.lit(seed)).alias("h")))
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for r in docs.groupBy("source", "tokens").count().collect():
        counts[r["source"]][r["tokens"]] = r["count"]
    want: dict[str, tuple[Fraction, int]] = {}
    for r in targets.collect():
        if r["source"] is not None and r["target_share"] is not None:
            want[r["source"].strip().lower()] = (Fraction(str(r["target_share"])), int(r["max_repeats"] or 0))
    there = {s: sum(n * k for n, k in counts[s].items()) for s in counts if s in want and want[s][0] > 0 and want[s][1] > 0}
    whole = sum(want[s][0] for s in there)
    total = min((Fraction(there[s] * want[s][1]) * whole / want[s][0] for s in there), default=Fraction(0))
    plan = []
    for s in sorted(there):
        quota = int(want[s][0] / whole * total)
        base = min(quota // there[s], want[s][1])
        more = fill(counts[s], quota - base * there[s]) if base < want[s][1] else {}
        plan += [(s, n, base, more.get(n, 0)) for n in sorted(counts[s]) if base or more.get(n)]
    buckets = max([1, *(-(-k // BUCKET_DOCS) for c in counts.values() for k in c.values())])
    plans = spark.createDataFrame(plan, "source string, tokens bigint, base int, take bigint")
    docs = docs.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")).join(plans, ["source", "tokens"])
    before = Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = docs.groupBy("source", "tokens", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    docs = docs.join(held, ["source", "tokens", "bucket"]).withColumn("left", F.col("take") - F.col("before"))
    cut = (F.col("left") > 0) & (F.col("left") < F.col("n"))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "bucket").orderBy("h", "doc_id"))
    inner = docs.where(cut).withColumn("more", (rank <= F.col("left")).cast("int"))
    outer = docs.where(~cut).withColumn("more", (F.col("left") > 0).cast("int"))
    parts = stable(inner.unionByName(outer).select("doc_id", "source", "tokens", (F.col("base") + F.col("more")).alias("repeats")).where("repeats > 0"))
    got = parts.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    all_tokens = got.agg(F.sum("tokens")).first()[0]
    goal = targets.select(plain.alias("source"), "target_share")
    took = F.coalesce("tokens", F.lit(0))
    shares = goal.join(got, "source", "left").select(
        "source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), took.alias("tokens"),
        F.coalesce(F.try_divide(took.cast("double"), F.lit(all_tokens).cast("double")), F.lit(0.0)).alias("actual_share"),
    )
    return parts, shares
