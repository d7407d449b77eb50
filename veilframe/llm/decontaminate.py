"""Benchmark items inside documents, up to a share of edited words: CGK embedding, bit-sampling LSH, exact edit distance.

A CGK walk reads a window from a start word: at each step it emits the word it stands on and moves on by one random
bit of (step, word).  Windows at a small edit distance walk together most of the time, so their outputs differ in few places (Hamming distance).
Each of ``TABLES`` samples ``SAMPLES`` places of the outputs as a key.  The windows of an item are taken at each of its words, those of a document too;
equal keys align an item with a stretch of the document of the item's size.  The alignment is verified by the edit distance over words.

An item just over a walk's length has few windows, so items of less than ``LONG`` words walk a shorter walk as well, and those of less
than ``SURE`` words aren't left to chance: cut into one piece more than the edits allowed, they keep a piece unedited, and pieces are keys.

The benchmark is the query set.  It is read in blocks of at most ``BLOCK_BYTES`` of text, each sent to the executors whole; documents are
never shuffled and all their windows are looked up.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.base import map_texts, mix, word_hashes

BLOCK_BYTES = 4 << 20
STEPS = (14, 7)            # outputs of a walk
LONG, SURE = 28, 20        # words of an item that walks only the longest walk; that walks at all
SHARE = 0.2                # edits, by words of the item, that walks are made for; pieces are taken beyond
WALKS = 2
SAMPLES = 6
RECALL, AGREE = 0.97, 0.85  # target recall of one window whose outputs agree in this share
TABLES = WALKS * math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE ** SAMPLES) / WALKS)
STRIP = 1 << 16            # windows walked at a time

_rng = np.random.default_rng(20)
_WALK = _rng.integers(1, 1 << 63, WALKS, dtype=np.uint64)
_FACTOR = _rng.integers(1, 1 << 63, (TABLES, max(STEPS)), dtype=np.uint64) | np.uint64(1)
_PLACES = {t: [np.sort(_rng.choice(t, min(t, SAMPLES), replace=False)) for _ in range(TABLES)] for t in STEPS}


def keys(words: np.ndarray, steps: int) -> np.ndarray:
    """One row per table: the key of the window that starts at each word."""
    n = len(words)
    out = np.zeros((TABLES, n), np.uint64)
    padded = np.concatenate([words, np.zeros(steps + 1, np.uint64)])
    for lo in range(0, n, STRIP):
        part = padded[lo:min(lo + STRIP, n) + steps + 1]
        m = len(part) - steps - 1
        for w in range(WALKS):
            coins = mix(part ^ _WALK[w])
            at = np.arange(m)
            tables = range(w, TABLES, WALKS)
            for t in range(steps):
                now = None
                for k in tables:
                    if t in _PLACES[steps][k]:
                        now = part[at] if now is None else now
                        out[k, lo:lo + m] += now * _FACTOR[k, t]
                bit = ((coins >> np.uint64(t)) & np.uint64(1)).astype(np.int8)
                at += bit[at]
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29)) ^ (np.arange(1, TABLES + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """One row: the key of the ``size`` words from each word on."""
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = np.zeros(len(words), np.uint64)
    for t in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[t:t + len(words)])
    return out[None, :]


def kinds(n: int, edits: int) -> list[tuple]:
    """(function, size, distance of the places taken) of the keys of an item of n words."""
    if n < SURE or edits > SHARE * n:
        size = max(n // (edits + 1), 1)
        return [(grams, size, size)]
    return [(keys, steps, 1) for steps in (STEPS if n < LONG else STEPS[:1])]


class Index:
    """The keys of a block of items of which a share of the words may be edited, by the kind of the keys."""

    def __init__(self, ids: list, texts: list[str | None], share: float = SHARE):
        words, at = word_hashes(texts, lower=True)
        self.ids = ids
        self.items = [words[at[i]:at[i + 1]] for i in range(len(ids))]
        self.known = [np.unique(x, return_counts=True) for x in self.items]
        self.tables = {}
        used: dict[tuple, list[int]] = {}
        for i, x in enumerate(self.items):
            for kind in kinds(len(x), int(share * len(x))) if len(x) else []:
                used.setdefault(kind, []).append(i)
        for (make, size, apart), own in used.items():
            found, item, offset = [], [], []
            for i in own:
                at_words = np.arange(0, len(self.items[i]) - size + 1, apart)
                k = make(self.items[i], size)[:, at_words]
                found.append(k.ravel())
                item.append(np.full(k.size, i))
                offset.append(np.tile(at_words, len(k)))
            found = np.concatenate(found)
            order = np.argsort(found, kind="stable")
            bits = int(np.clip(math.ceil(math.log2(len(found))) + 6, 16, 27))
            seen = np.zeros(1 << bits, bool)
            seen[(found >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables[make, size, apart] = found[order], np.concatenate(item)[order], np.concatenate(offset)[order], bits, seen

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the window, position where the item would start, item) of all equal keys."""
        windows, starts, items = ([np.empty(0, np.int64)] for _ in range(3))
        for (make, size, _), (found, item, offset, bits, seen) in self.tables.items():
            for k in make(words, size):
                at = np.flatnonzero(seen[(k >> np.uint64(64 - bits)).astype(np.int64)])
                lo, hi = np.searchsorted(found, k[at]), np.searchsorted(found, k[at], side="right")
                at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                if len(at):
                    pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    windows.append(np.repeat(at, n))
                    starts.append(windows[-1] - offset[pick])
                    items.append(item[pick])
        return np.concatenate(windows), np.concatenate(starts), np.concatenate(items)


def _ends(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Edit distance of the item to the best stretch of the text that ends before each position 0..len(text)."""
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[:-1] + (text != w), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - at) + at
    return row


def present(known: tuple[np.ndarray, np.ndarray], text: np.ndarray) -> int:
    """How many words of an item, given as its sorted distinct words and their numbers, stand in the text."""
    words, times = known
    at = np.minimum(np.searchsorted(words, text), len(words) - 1)
    seen = np.zeros(len(words), bool)
    seen[at[words[at] == text]] = True
    return int(times[seen].sum())


def matches(item: np.ndarray, text: np.ndarray, edits: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """Separate stretches (start, end, distance) of the text within ``edits`` of the item: the best ones first, of equal ones the leftmost.

    The distances are worked out once.  Taking a stretch changes only those of stretches that would reach into it from behind, so each hit costs a
    stretch of the item's size, however many there are.
    """
    if len(text) < len(item) - edits or len(item) == 0:
        return []
    if present(known or np.unique(item, return_counts=True), text) < len(item) - edits:
        return []
    reach = len(item) + edits           # no stretch within the edits is longer
    far = _ends(item, text)
    heap = [(int(far[j]), int(j)) for j in np.flatnonzero(far <= edits)]
    heapq.heapify(heap)
    starts, ends, distances = [], [], []        # of the stretches taken, in order
    while heap:
        distance, end = heapq.heappop(heap)
        k = bisect_left(ends, end)
        if distance != far[end] or (k < len(ends) and starts[k] < end):
            continue
        low = max(ends[k - 1] if k else 0, end - reach)
        back = _ends(item[::-1], text[low:end][::-1])
        best = np.flatnonzero(back == distance)
        start = end - int(best[np.abs(best - len(item)).argmin()])
        high = min(starts[k] if k < len(starts) else len(text), end + reach)
        starts.insert(k, start)
        ends.insert(k, end)
        distances.insert(k, distance)
        far[end + 1:high + 1] = _ends(item, text[end:high])[1:]
        for j in np.flatnonzero(far[end + 1:high + 1] <= edits) + end + 1:
            heapq.heappush(heap, (int(far[j]), int(j)))
    return list(zip(starts, ends, distances, strict=True))


def find(index: Index, words: np.ndarray, starts: np.ndarray, items: np.ndarray, share: float) -> list[tuple[int, int, int, int]]:
    """(item, start, end, distance) among one document's candidates."""
    order = np.lexsort((starts, items))
    starts, items = starts[order], items[order]
    out = []
    lo = 0
    while lo < len(starts):
        item = index.items[items[lo]]
        edits = int(share * len(item))
        hi = lo + 1
        while hi < len(starts) and items[hi] == items[lo] and starts[hi] - starts[hi - 1] <= len(item) + 2 * edits:
            hi += 1
        begin = max(0, int(starts[lo]) - edits)
        stretch = words[begin:max(0, int(starts[hi - 1]) + len(item) + edits)]
        out += [(items[lo], begin + a, begin + b, d) for a, b, d in matches(item, stretch, edits, index.known[items[lo]])]
        lo = hi
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance): each stretch of a document within ``share`` * item words of an item.

    Words are lower-cased (A-Z) runs of anything but white space; ``distance`` counts inserted, deleted and replaced words.
    Reads doc_id and text of ``docs`` and item_id and text of ``benchmark``; other columns are not read.  A null or empty text, of
    a document or an item, matches nothing.  Repeated rows are reported each.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word long, end_word long, distance long"

    def search(block: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        sent = spark.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], share))

        def work(batches: Iterator[pd.DataFrame]):
            index = sent.value
            for pdf in batches:
                out = []
                words, at = word_hashes(pdf["text"].tolist(), lower=True)
                windows, starts, found = index.candidates(words)
                which = np.searchsorted(at, windows, side="right") - 1
                for k in np.unique(which):
                    own = which == k
                    out += [(pdf["doc_id"].iloc[k], index.ids[i], s, e, d)
                            for i, s, e, d in find(index, words[at[k]:at[k + 1]], starts[own] - at[k], found[own], share)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "start_word", "end_word", "distance"]).astype("Int64")

        return map_texts(texts, work, schema)

    return reduce(DataFrame.unionByName, [search(k) for k in range(blocks)])
