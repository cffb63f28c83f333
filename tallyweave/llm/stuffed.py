"""Texts whose larger part is stuffed keywords, links or product tags."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .words import _TIME

#: Words of a window, and the step between windows.
WINDOW, STEP = 40, 10
#: Share of distinct words below which a window is stuffed, in any words and in words without grammar.
FEW_WORDS, FEW_KEYWORDS = 0.45, 0.66
#: Share of a window in content words that stand in it three times or more, from which it is stuffed.
REPEATED = 0.3
#: Share of function words below which a window is no sentence.
GRAMMAR = 0.15
#: Links of fewer than so many, or to one host alone and fewer than MANY_LINKS, are no list.
LINKS, MANY_LINKS = 4, 8

# Function words of the languages of the house.
FUNCTION_WORDS = frozenset(
    "the a an of to in for on and or but is was were be that this it with at by from as we you i he she they our your their his her my so not what who when had has have are than older us them "
    "el la los las de del que y en un una por con para se su al lo no es como mas pero quien o os as da do das dos e em um uma com seu sua ao nao na "
    "der die das den dem des und oder im ein eine einen einem einer von zu zum zur mit auf für nach bei nicht ist war hat es sich uns über sein seine".split()
)
_URL = r"(?:https?://|www\.)[^\s<>\")\]]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|info|biz|shop|site|invalid|test|example)(?:/[^\s<>\")\]]*)?(?![\w@])"
_LINK = re.compile(rf"<a\b[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|{_URL}", re.I | re.S)
_HOST = re.compile(r"(?:https?://)?(?:www\.)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)", re.I)
_WARE = re.compile(r"(?:[$€£]\s?\d+[.,]?\d*|\b(?:usd|eur|gbp)\s?\d+|\b\d+[.,]\d{2}\b|\bsku\s?-?\d+|add to cart|in stock|buy now|free shipping|\btags:)", re.I)
_CLOCK = re.compile(r"\b\d{1,2}(?::\d{2}|\s?[ap]m)\b", re.I)
_HASHTAG = re.compile(r"#[^\W_]{2,}")
_TAGGED = re.compile(r"<[!/?a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
# What a link, or a line of wares without a digit, can't do without.
_LINKISH = ("://", "www.", "<a", "](", ".com", ".net", ".org", ".info", ".biz", ".shop", ".site", ".invalid", ".test", ".example")
_WAREISH = ("#", "add to cart", "in stock", "buy now", "free shipping", "tags:")


def _hosts(links: list[str]) -> list[str]:
    return [m[1].lower() for x in links if (m := _HOST.search(x[x.find("href") + 4 :] if "href" in x else x[x.rfind("](") + 2 :] if "](" in x else x))]


def stuffed_share(text: str) -> float:
    """Share of the letters of a text that stand in lists of links, product lines and stuffed windows.

    Whether links are a list is told by their hosts: several hosts, or one linked over and over.
    The rest is read in windows: a window is stuffed if it has few distinct words for its length
    or a few content words fill it, and the fewer function words it has the sooner. Lines of a rota (with a time of
    day) count as they are: read, and never stuffed. A list of names has no grammar either, but its
    words differ; a refrain has few words, but not few in every window of it.
    """
    if ":" in text:
        text = _TIME.sub(" ", text)
    low = text.lower()
    listed = 0
    if any(x in low for x in _LINKISH):
        links = _LINK.findall(text)
        hosts = _hosts(links)
        if len(hosts) >= LINKS and (len(set(hosts)) > 1 or len(hosts) >= MANY_LINKS):
            listed = sum(sum(map(len, _WORD.findall(x))) for x in links)
        text = _LINK.sub(" ", text)
    if "<" in text:
        text = _TAGGED.sub(" ", text)
    wares = rota = 0
    if any(x in low for x in _WAREISH) or _DIGIT.search(text):
        rest = []
        for line in text.splitlines():
            if len(_WARE.findall(line)) >= 2 or line.count("#") >= 6 and len(_HASHTAG.findall(line)) >= max(6, len(_WORD.findall(line)) // 2):
                wares += sum(map(len, _WORD.findall(line)))
            elif _CLOCK.search(line):
                rota += sum(map(len, _WORD.findall(line)))
            else:
                rest += [w for w in _WORD.findall(line.casefold()) if not w.isdigit()]
    else:
        rest = _WORD.findall(text.casefold())
    bad = _stuffed_words(rest)
    stuffed = sum(len(w) for w, b in zip(rest, bad) if b)
    total = listed + wares + rota + sum(map(len, rest))
    return (listed + wares + stuffed) / total if total else 0.0


def _stuffed_words(rest: list[str]) -> list[bool]:
    """Which words stand in a stuffed window."""
    bad = [False] * len(rest)
    # Content words stand for themselves, function words for nothing; plain counts the latter before each place.
    content = ["" if w in FUNCTION_WORDS else w for w in rest]
    plain = [0, *accumulate(not w for w in content)]
    for at in range(0, len(rest), STEP):
        lo = max(0, min(at, len(rest) - WINDOW))
        hi = min(at + WINDOW, len(rest))
        n = hi - lo
        if n < WINDOW // 2:
            continue
        distinct = len(set(rest[lo:hi])) / n
        grammar = plain[hi] - plain[lo]
        if distinct < FEW_WORDS or grammar < GRAMMAR * n and distinct < FEW_KEYWORDS:
            bad[lo:hi] = [True] * n
            continue
        # Words that stand three times or more make up at most 3/2 of the repeats: without so many there is nothing to count.
        own = set(content[lo:hi])
        own.discard("")
        if n - grammar - len(own) >= REPEATED * n * 2 / 3 - 1e-9:
            count = Counter(content[lo:hi])
            if sum(k for w, k in count.items() if k >= 3 and w) >= REPEATED * n:
                bad[lo:hi] = [True] * n
    return bad


def stuffed_documents(documents: DataFrame, share: float = 0.5) -> DataFrame:
    """``doc_id, share`` of each document of which more than ``share`` is stuffed.

    ``documents (doc_id, text)``, each text read whole, one pass, no shuffle. NULL texts are none; a
    document given twice comes out twice.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "share": [stuffed_share(t) for t in pdf["text"]]})
            yield out[out["share"] > share].astype({"doc_id": "int64", "share": "float64"})

    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return spread(texts).mapInPandas(run, "doc_id bigint, share double")
