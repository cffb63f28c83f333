"""Passages of held-out items in documents, found by a suffix automaton over the items."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .words import words

#: A passage has this many words or more of its item, or all of them.
PASSAGE = 18
#: Words of an exact run that starts an alignment; an 18-word passage with two altered words has one.
SEED = 5
#: Of the weight of the item's words in a passage, so much stands in the document; the rest is altered.
KEPT = 0.8


#: Cells between two documents, or items, that no step of an alignment leads across.
PAD = 16
#: How many words the document and the item are ahead after an alteration, in the order they are tried.
_STEPS = ((1, 1), (1, 0), (0, 1), (2, 1), (2, 0), (3, 0), (2, 2))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _runs(ids: np.ndarray) -> np.ndarray:
    """Where ``SEED`` known words (not 0) begin, along the last axis."""
    known = np.cumsum(np.pad(ids > 0, [(0, 0)] * (ids.ndim - 1) + [(1, SEED - 1)]), axis=-1)
    return known[..., SEED:] - known[..., :-SEED] == SEED


def _hashed(ids: np.ndarray) -> np.ndarray:
    """A hash of the ``SEED`` words from each place on, along the last axis."""
    x = np.pad(ids, [(0, 0)] * (ids.ndim - 1) + [(0, SEED - 1)]).astype(np.uint64)
    out = np.zeros(ids.shape, dtype=np.uint64)
    for k in range(SEED):
        out = (out + x[..., k : k + ids.shape[-1]] + np.uint64(1)) * _PRIME
        out ^= out >> np.uint64(29)
    return out * _PRIME


def _reach(doc: np.ndarray, item: np.ndarray, at: np.ndarray, on: np.ndarray, step: int) -> np.ndarray:
    """Words of the item from each place ``on`` to the last one that ``_align`` would hit, for many runs at once."""
    out, who = np.zeros(len(at), dtype=np.int64), np.arange(len(at))
    at, on, begun, miss = at.copy(), on.copy(), on.copy(), np.zeros(len(at), dtype=np.int64)
    while len(who):
        same = doc[at] == item[on]
        out[who[same]] = np.abs(on[same] - begun[same]) + 1
        miss[same] = 0
        ahead, aside = np.ones(len(who), dtype=np.int64), np.ones(len(who), dtype=np.int64)
        open_ = ~same
        miss[open_] += 1
        for da, do in _STEPS:
            a, o = at[open_] + da * step, on[open_] + do * step
            fits = np.zeros(len(who), dtype=bool)
            fits[open_] = (doc[a] == item[o]) & (doc[a + step] == item[o + step])
            ahead[fits], aside[fits] = da, do
            miss[fits] += max(da, do) - 1
            open_ &= ~fits
        at, on = at + ahead * step, on + aside * step
        live = miss <= 2
        who, at, on, begun, miss = who[live], at[live], on[live], begun[live], miss[live]
    return out


class Automaton:
    """Suffix automaton over the words of all items; ``ends`` holds every place a state ends at."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.next, self.link, self.len, self.ends = [{}], [-1], [0], [[]]
        for item, ws in items:
            last = 0
            for at, w in enumerate(ws):
                last = self._step(last, w)
                self.ends[last].append((item, at))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.len[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]].extend(self.ends[v])

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.len.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _clone(self, v: int, w: str, q: int) -> int:
        k = self._new(self.len[v] + 1)
        self.next[k], self.link[k], self.link[q] = dict(self.next[q]), self.link[q], k
        while v != -1 and self.next[v].get(w) == q:
            self.next[v][w] = k
            v = self.link[v]
        return k

    def _step(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur, v = self._new(self.len[last] + 1), last
        while v != -1 and w not in self.next[v]:
            self.next[v][w] = cur
            v = self.link[v]
        if v == -1:
            self.link[cur] = 0
        else:
            q = self.next[v][w]
            self.link[cur] = q if self.len[q] == self.len[v] + 1 else self._clone(v, w, q)
        return cur

    def seeds(self, ws: list[str], least: int) -> Iterator[tuple[int, int, int, int]]:
        """``(item, place in the document, place in the item, words)`` of the maximal common runs."""
        nxt, link, length = self.next, self.link, self.len
        v = n = 0
        for k in range(len(ws) + 1):
            w = ws[k] if k < len(ws) else None
            to = nxt[v].get(w)
            if to is None:
                # What ends here: the longest run, and at shorter suffixes the items that have only those.
                u, ul, seen = v, n, set()
                while ul >= least:
                    for item, at in self.ends[u]:
                        if (item, at) not in seen:
                            seen.add((item, at))
                            yield item, k - ul, at - ul + 1, ul
                    u = link[u]
                    ul = length[u] if u > 0 else 0
                while v and w not in nxt[v]:
                    v = link[v]
                n = length[v] if v else 0
                to = nxt[v].get(w)
            if to is None:
                v = n = 0
            else:
                v, n = to, n + 1


def _align(doc: list[str], item: list[str], at: int, on: int, step: int) -> list[int]:
    """Places of the item that stand in the document, walking from ``(at, on)`` by ``step``.

    An altered word is passed over; after up to three words too many, or one too few, the walk goes on where the
    next two words agree. It ends after more than two altered words in a row.
    """
    hit, miss, last, end = [], 0, len(doc), len(item)
    while 0 <= at < last and 0 <= on < end:
        if doc[at] == item[on]:
            hit.append(on)
            miss = 0
            at, on = at + step, on + step
            continue
        for da, do in _STEPS:
            a, o = at + da * step, on + do * step
            if 0 <= a < last and 0 <= o < end and doc[a] == item[o] and 0 <= (a := a + step) < last and 0 <= (o := o + step) < end and doc[a] == item[o]:
                at, on, miss = at + da * step, on + do * step, miss + max(da, do)
                break
        else:
            at, on, miss = at + step, on + step, miss + 1
        if miss > 2:
            break
    return hit


class Finder:
    """The automaton over all items, and what decides whether a common run belongs to a passage."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = {i: words(t) for i, t in items}
        self.words = {i: ws for i, ws in self.words.items() if ws}
        self.automaton = Automaton(list(self.words.items()))
        held: dict[str, int] = {}
        for ws in self.words.values():
            for w in set(ws):
                held[w] = held.get(w, 0) + 1
        self.weight = {w: 1 + math.log(len(self.words) / n) for w, n in held.items()}
        self.least = min([SEED, *(len(ws) for ws in self.words.values())])
        self._lay_out()

    def _lay_out(self) -> None:
        """All items in one row of word numbers, padded, and an index of their runs of ``SEED`` words."""
        self.number = {w: k for k, w in enumerate(self.weight, 1)}
        flat, owner = [-1] * PAD, [0] * PAD
        self.order = list(self.words)
        for r, ws in enumerate(self.words.values()):
            flat += [self.number[w] for w in ws] + [-1] * PAD
            owner += [r] * (len(ws) + PAD)
        self.flat, self.owner = np.array(flat), np.array(owner)
        self.need = np.array([min(PASSAGE, len(ws)) for ws in self.words.values()], dtype=np.int64)
        ons = np.nonzero(_runs(self.flat))[0]
        keys = _hashed(self.flat)[ons]
        by = np.argsort(keys, kind="stable")
        self.keys, self.ons = keys[by], ons[by]
        self.filter = np.zeros(1 << 18, dtype=bool)
        self.filter[(self.keys >> np.uint64(46)).astype(np.int64)] = True

    def likely(self, docs: list[list[str]]) -> set[int]:
        """Places of the documents with a common run whose alignment spans as much as a passage.

        All runs of all documents are aligned at once, by the rule of ``_align``, so a document left
        out has no passage. With an item of fewer than ``SEED`` words, every document stays.
        """
        if not self.order:
            return set()
        if self.least < SEED:
            return set(range(len(docs)))
        get, gap = self.number.get, [-2] * PAD
        flat, starts = list(gap), []
        for ws in docs:
            starts.append(len(flat))
            flat += [get(w, 0) for w in ws]
            flat += gap
        ids = np.array(flat)
        keys = _hashed(ids)
        at = np.nonzero(_runs(ids) & self.filter[(keys >> np.uint64(46)).astype(np.int64)])[0]
        lo, hi = np.searchsorted(self.keys, keys[at]), np.searchsorted(self.keys, keys[at], side="right")
        n = hi - lo
        on = self.ons[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at = np.repeat(at, n)
        first = ids[at - 1] != self.flat[on - 1]
        at, on = at[first], on[first]
        span = _reach(ids, self.flat, at - 1, on - 1, -1) + _reach(ids, self.flat, at, on, 1)
        wide = at[span >= self.need[self.owner[on]]]
        return set((np.searchsorted(starts, wide, side="right") - 1).tolist())

    def found(self, text: str | None) -> list[int]:
        """Items of which the text holds a passage."""
        return self.found_in([text])[0]

    def found_in(self, texts: Sequence[str | None]) -> list[list[int]]:
        """Items of which each of the texts holds a passage."""
        docs = [words(t) for t in texts]
        likely = self.likely(docs)
        return [self._streamed(doc) if k in likely else [] for k, doc in enumerate(docs)]

    def _streamed(self, doc: list[str]) -> list[int]:
        out: set[int] = set()
        for item, at, on, n in self.automaton.seeds(doc, self.least):
            ws = self.words[item]
            if item not in out and n >= min(SEED, len(ws)) and (n >= min(PASSAGE, len(ws)) or self.passage(doc, ws, at, on, n)):
                out.add(item)
        return sorted(out)

    def passage(self, doc: list[str], ws: list[str], at: int, on: int, n: int) -> bool:
        hit = _align(doc, ws, at - 1, on - 1, -1)[::-1] + list(range(on, on + n)) + _align(doc, ws, at + n, on + n, 1)
        return self.whole(ws, hit)

    def whole(self, ws: list[str], hit: list[int]) -> bool:
        """Whether some stretch of the item is long enough and little enough of it is altered."""
        if not hit or hit[-1] - hit[0] + 1 < min(PASSAGE, len(ws)):
            return False
        total = [0.0]
        for w in ws:
            total.append(total[-1] + self.weight[w])
        kept = [0.0]
        for p in hit:
            kept.append(kept[-1] + self.weight[ws[p]])
        need = min(PASSAGE, len(ws))
        for i in range(len(hit)):
            for j in range(len(hit) - 1, i, -1):
                if hit[j] - hit[i] + 1 < need:
                    break
                if kept[j + 1] - kept[i] >= KEPT * (total[hit[j] + 1] - total[hit[i]]):
                    return True
        return False


@lru_cache(maxsize=2)
def _finder(items: tuple[tuple[int, str], ...]) -> Finder:
    return Finder(list(items))


def held_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of each document that holds a passage of an item.

    ``documents (doc_id, text)`` of any size are read once, each text whole and without a shuffle;
    ``items (item_id, text)`` make the automaton and must fit a worker. Texts and items that are
    NULL or without a word hold nothing; an item given twice counts once, a document given twice
    comes out twice.
    """
    eval_items = tuple(sorted({(r["item_id"], r["text"]) for r in items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).collect()}))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _finder(eval_items)
        for pdf in parts:
            rows = [(d, i) for at in range(0, len(pdf), 500) for d, got in zip(pdf["doc_id"][at : at + 500], finder.found_in(pdf["text"][at : at + 500])) for i in got]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"]).astype("int64")

    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return spread(texts).mapInPandas(run, "doc_id bigint, item_id bigint")
