"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, so a misspelling shares most of its vectors with the word.  A bag of ``BAG`` words is
the average of its words; a document's evidence is its most toxic bag, so a few words are not lost in a long text.  The
bags' softmax and the vectors are fitted on a bounded sample; each pass learns from every document's strongest bag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.base import map_texts
from veilframe.llm.labelled import held_out, sample

SAMPLE_ROWS = 2_000     # labelled documents the model is fitted on, whole texts
BUCKETS, SIZE = 1 << 18, 8
GRAMS = (3, 4, 5, 6)
BAG, STRIDE = 6, 3
PASSES, RATE, BATCH = 14, 0.4, 64
WARM, WARM_BAGS = 4, 30_000
THRESHOLD = 0.3
CHUNK = 400_000  # characters that are hashed at a time
_EDGE = np.zeros(0x110000, bool)
_EDGE[[*range(0x21), *map(ord, ".,;:!?\"'()[]{}|*#$%&<>-_"), 0x85, 0xA0]] = True
_STEP = np.uint32(0x01000193)


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram, in the order of the words, and each text's first word (n + 1 offsets).

    A word is a run of characters other than white space and punctuation; its n-grams may take in one mark at either end.
    """
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    mark = np.zeros(1, np.uint32)
    c = np.concatenate([mark] + [x for own in codes for x in (own, mark)])
    edge = _EDGE[c]
    c = np.where(edge, np.uint32(1), c * np.uint32(2654435761))
    begins = ~edge & np.concatenate([[True], edge[:-1]])
    word = np.cumsum(begins) - 1
    ends = np.cumsum([1] + [len(x) + 1 for x in codes])
    offsets = np.concatenate([[0], np.cumsum(begins)])[ends]
    inner = np.concatenate([[0], np.cumsum(edge)])
    buckets, owners = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    h = c
    for n in range(2, min(max(GRAMS), len(c)) + 1):
        h = h[:-1] * _STEP ^ c[n - 1:]
        if n in GRAMS:
            i = np.flatnonzero(inner[n - 1:len(c)] == inner[1:len(c) - n + 2])  # no mark inside
            g = h[i]
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            buckets.append((g >> np.uint32(32 - 18)).astype(np.int32))
            owners.append(word[i + 1].astype(np.int32))
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order], offsets


def bag_starts(n: int) -> np.ndarray:
    """Starts of half-overlapping bags that cover n words."""
    return np.arange(0, max(n - STRIDE, 1), STRIDE) if n else np.empty(0, np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """scores(texts), each 0..1."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.margin = np.zeros(BUCKETS, np.float32)
        self.bias = 0.0
        self.calibration = np.array([1.0, 0.0, 0.0])
        labels = np.array([y for _, y in rows], int)
        if len(set(labels.tolist())) == 2:
            self._fit([t for t, _ in rows], labels)
        elif len(labels):
            self.calibration = np.array([0.0, 0.0, 4.0 if labels[0] else -4.0])

    def _fit(self, texts: list[str], labels: np.ndarray) -> None:
        bags, owner = [], []
        for d, text in enumerate(texts):
            bucket, word, at = subwords([text])
            s = bag_starts(at[-1])
            lo, hi = np.searchsorted(word, s), np.searchsorted(word, np.minimum(s + BAG, at[-1]))
            bags += [bucket[x:y] for x, y in zip(lo, hi, strict=True) if y > x]
            owner += [d] * int((hi > lo).sum())
        owner = np.array(owner, int)
        size = np.array([len(b) for b in bags], int)
        flat, begin = np.concatenate(bags), np.concatenate([[0], np.cumsum(size)[:-1]])
        bags = None
        rng = np.random.default_rng(6)
        vectors, weights, bias = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32), rng.normal(0, 0.1, (SIZE, 2)), np.zeros(2)
        seen, seen_w = np.full(BUCKETS, 1e-4, np.float32), np.full((SIZE, 2), 1e-4)

        def strengths() -> np.ndarray:
            per = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
            return np.add.reduceat(per[flat], begin) / size + bias[1] - bias[0]

        for step in range(PASSES):
            if step < WARM:  # any bag with its document's label
                chosen = rng.permutation(len(size))[:WARM_BAGS]
            else:            # each document's strongest bag, and more of the clean documents'
                order = np.lexsort((-strengths(), owner))
                best = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
                clean = rng.permutation(np.flatnonzero(labels[owner] == 0))
                chosen = rng.permutation(np.concatenate([best, clean[:2 * len(best)]]))
            for lo in range(0, len(chosen), BATCH):
                k = chosen[lo:lo + BATCH]
                part = np.concatenate([flat[begin[x]:begin[x] + size[x]] for x in k])
                first = np.concatenate([[0], np.cumsum(size[k])[:-1]])
                mean = np.add.reduceat(vectors[part], first, axis=0) / size[k][:, None]
                logits = mean @ weights + bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                y = labels[owner[k]]
                p[np.arange(len(k)), y] -= 1
                p *= np.where(y == 1, 3.0, 1.0)[:, None]
                grad_w, back = mean.T @ p / len(k), (p @ weights.T) / size[k][:, None]
                used, where = np.unique(part, return_inverse=True)
                spread = np.repeat(np.arange(len(k)), size[k])
                grad = np.stack([np.bincount(where, back[spread, j], len(used)) for j in range(SIZE)], axis=1)
                seen[used] += (grad ** 2).mean(axis=1)
                vectors[used] -= RATE * grad / np.sqrt(seen[used])[:, None]
                seen_w += grad_w ** 2
                weights -= RATE * grad_w / np.sqrt(seen_w)
                bias -= 0.1 * p.mean(axis=0)
        top, n = np.full(len(texts), -5.0), np.bincount(owner, minlength=len(texts))
        np.maximum.at(top, owner, strengths())
        self.margin = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])
        x = np.stack([np.clip(top, -8, 8), np.log1p(n), np.ones(len(top))], axis=1)
        for _ in range(50):  # Newton steps of a logistic regression, held back by a small ridge
            p = _sigmoid(x @ self.calibration)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (labels - p) - 0.5 * self.calibration)
            self.calibration = self.calibration + np.clip(step, -2, 2)

    def scores(self, texts: list[str | None]) -> list[float]:
        out, lo = [], 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") <= CHUNK):
                held += len(texts[hi] or "")
                hi += 1
            bucket, word, at = subwords(texts[lo:hi])
            total = np.concatenate([[0.0], np.cumsum(np.bincount(word, self.margin[bucket], at[-1]))])
            count = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=at[-1]))])
            for k in range(hi - lo):
                s = at[k] + bag_starts(at[k + 1] - at[k])
                e = np.minimum(s + BAG, at[k + 1])
                n = count[e] - count[s]
                top = float(((total[e] - total[s])[n > 0] / n[n > 0]).max(initial=-5.0 - self.bias)) + self.bias
                out.append(float(_sigmoid(self.calibration @ np.array([min(max(top, -8), 8), np.log1p(len(s)), 1.0]))))
            lo = hi
        return out


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text; other columns are not read).

    ``score`` is 0 to 1, higher where ``labels`` (doc_id, toxic) would rather say 1; whole texts are scored.  The model is fitted on at most
    ``rows`` labelled documents outside the held-out fold, whole texts.  A null or empty text has no bag and takes
    the lowest evidence.  With labels of one class, or none, all scores are alike.  An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Model(sample(docs, labels, "toxic", rows)))

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"].array, "score": sent.value.scores(pdf["text"].tolist())})

    own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = map_texts(own, work, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
