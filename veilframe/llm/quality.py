"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's evidence is its own features and those of the lines before and after; neighbouring
labels are tied by transition weights.  Weights are fitted in numpy on a bounded sample, a document's label standing for each of its lines.  Forward-backward
gives each line's marginal; a document's quality is their mean weighted by the lines' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.base import map_texts, mix, word_hashes
from veilframe.llm.labelled import held_out, sample

SAMPLE_ROWS = 1_500     # labelled documents the model is fitted on, whole texts
THRESHOLD = 0.7
STEPS, RATE, RIDGE = 100, 0.3, 1e-3
CHUNK = 2_000_000  # characters whose lines are laid out at a time

_CLASS = {"upper": range(65, 91), "letter": [*range(65, 91), *range(97, 123), *range(0xC3, 0x100)], "digit": range(48, 58),
          "symbol": b"#*$%&<>", "bar": b"|", "shout": b"!", "mark": b".,;:?"}
_MEMBER = {k: np.isin(np.arange(256), list(v)).astype(np.float64) for k, v in _CLASS.items()}
_STOP = np.isin(np.arange(256), list(b".!?:;\"')]"))


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, f) of the lines that hold a word, their lengths in bytes, and each text's first line (n + 1 offsets)."""
    words, at, start, end, data = word_hashes(texts, lower=False, spans=True)
    shift = np.cumsum([0] + [len(d) + 1 for d in data])
    a = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    line_of_byte = np.cumsum(a == 10) - (a == 10)
    doc_of_word = np.repeat(np.arange(len(data)), np.diff(at))
    line = line_of_byte[start + shift[doc_of_word]] if len(words) else np.empty(0, np.int64)
    lines, line = np.unique(line, return_inverse=True)
    n = len(lines)
    if not n:
        return np.empty((0, 12)), np.empty(0), np.zeros(len(data) + 1, np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1])
    last = np.concatenate([first[1:], [len(words)]]) - 1
    n_words = (last - first + 1).astype(float)
    lo, hi = (start + shift[doc_of_word])[first], (end + shift[doc_of_word])[last]
    length = (hi - lo).astype(float)

    def count(member: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(member[a])])
        return total[hi] - total[lo]

    c = {k: count(m) for k, m in _MEMBER.items()}
    again = np.concatenate([[False], (words[1:] == words[:-1]) & (line[1:] == line[:-1])])
    named = np.unique(line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ words, return_index=True)[1]
    distinct = np.bincount(line[named], minlength=n)
    place = np.arange(len(words)) - first[line] + 1
    whole = np.add.reduceat(mix(words * place.astype(np.uint64)), first) ^ (doc_of_word[first].astype(np.uint64) << np.uint64(32))
    _, which, times = np.unique(whole, return_inverse=True, return_counts=True)
    size = np.maximum(length, 1)
    f = np.stack([
        np.log1p(length) / 5, np.log1p(n_words) / 4, _STOP[a[hi - 1]].astype(float), c["upper"] / np.maximum(c["letter"], 1),
        np.minimum(c["symbol"] / n_words, 3), c["bar"] / n_words, np.minimum(c["shout"] / n_words, 2), c["digit"] / size,
        np.bincount(line, again, n) / n_words, distinct / n_words, (times[which] > 1).astype(float), np.minimum(c["mark"] / n_words, 2)], axis=1)
    owner = doc_of_word[first]
    return f, length, np.searchsorted(owner, np.arange(len(data) + 1))


def _neighbours(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at the ends), and a constant."""
    begins = np.zeros(len(f) + 1, bool)
    begins[at] = True
    before = np.where(begins[:-1, None], 0, np.concatenate([np.zeros((1, f.shape[1])), f[:-1]]) if len(f) else f)
    after = np.where(begins[1:, None], 0, np.concatenate([f[1:], np.zeros((1, f.shape[1]))]) if len(f) else f)
    return np.concatenate([f, before, after, np.ones((len(f), 1))], axis=1)


def forward_backward(unary: np.ndarray, real: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (document, place, 2) and pair marginals summed over places (2, 2).  unary: log scores (document, place, 2)."""
    docs, places, _ = unary.shape
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    for t in range(places):
        step = unary[:, t] if t == 0 else unary[:, t] + np.logaddexp(forward[:, t - 1, 0, None] + ties[0], forward[:, t - 1, 1, None] + ties[1])
        forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1] if t else 0)
    for t in range(places - 2, -1, -1):
        nxt = unary[:, t + 1] + backward[:, t + 1]
        step = np.logaddexp(nxt[:, 0, None] + ties[:, 0], nxt[:, 1, None] + ties[:, 1])
        backward[:, t] = np.where(real[:, t + 1, None], step, 0)
    both = forward + backward
    whole = np.logaddexp(both[..., 0], both[..., 1])
    marginal = np.exp(both - whole[..., None]) * real[..., None]
    pairs = np.zeros((2, 2))
    if places > 1:
        joint = forward[:, :-1, :, None] + ties + (unary + backward)[:, 1:, None, :] - whole[:, 1:, None, None]
        pairs = (np.exp(np.minimum(joint, 0)) * real[:, 1:, None, None]).sum(axis=(0, 1))
    return marginal, pairs


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """scores(texts), each 0..1."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.mean, self.scale = np.zeros(12), np.ones(12)
        self.weights, self.ties, self.calibration = np.zeros(37), np.zeros((2, 2)), np.array([1.0, 0.0])
        labels = np.array([y for _, y in rows], int)
        if len(set(labels.tolist())) == 2:
            self._fit([t for t, _ in rows], labels)
        elif len(labels):
            self.calibration = np.array([0.0, 4.0 if labels[0] else -4.0])

    def _fit(self, texts: list[str], labels: np.ndarray) -> None:
        f, _, at = line_features(texts)
        self.mean, self.scale = f.mean(axis=0), f.std(axis=0) + 1e-6
        x = _neighbours((f - self.mean) / self.scale, at)
        held = np.diff(at) > 0
        gold = np.repeat(labels, np.diff(at))
        batches = [(self._layout(at, g), labels[g]) for g in self._groups(at)]
        seen, seen_t = np.full(x.shape[1], 1e-3), np.full((2, 2), 1e-3)
        n = len(f)
        for _ in range(STEPS):
            score = x @ self.weights
            grad, grad_t = x.T @ gold / n, np.zeros((2, 2))
            expected = np.zeros(n)
            for (grid, real), y in batches:
                unary = np.stack([np.zeros(grid.shape), score[grid]], axis=2)
                marginal, pairs = forward_backward(unary, real, self.ties)
                expected[grid[real]] = marginal[..., 1][real]
                moves = real[:, 1:].sum(axis=1)
                grad_t += np.array([[moves[y == 0].sum(), 0], [0, moves[y == 1].sum()]]) - pairs
            grad -= x.T @ expected / n + RIDGE * self.weights
            grad_t = grad_t / n - 0.02 * self.ties
            seen += grad ** 2
            seen_t += grad_t ** 2
            self.weights = self.weights + RATE * grad / np.sqrt(seen)
            self.ties = self.ties + RATE * grad_t / np.sqrt(seen_t)
        raw = self._raw(texts)
        z = np.stack([raw[held], np.ones(held.sum())], axis=1)
        for _ in range(50):  # Newton steps of a logistic regression, held back by a small ridge
            p = _sigmoid(z @ self.calibration)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (labels[held] - p) - 0.1 * self.calibration)
            self.calibration = self.calibration + np.clip(step, -2, 2)

    @staticmethod
    def _groups(at: np.ndarray) -> list[np.ndarray]:
        """Documents of alike numbers of lines, so that little of a grid is empty."""
        n = np.diff(at)
        kind = np.ceil(np.log2(np.maximum(n, 1))).astype(int)
        return [np.flatnonzero((kind == k) & (n > 0)) for k in np.unique(kind[n > 0])]

    @staticmethod
    def _layout(at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Line numbers laid out as (document, place), and which places hold a line."""
        n = np.diff(at)[docs]
        place = np.arange(n.max())
        real = place[None, :] < n[:, None]
        return np.where(real, at[:-1][docs][:, None] + place[None, :], 0), real

    def _raw(self, texts: list[str | None]) -> np.ndarray:
        """Log odds of the length-weighted mean marginal; -8 without lines."""
        f, length, at = line_features(texts)
        out = np.full(len(texts), -8.0)
        score = _neighbours((f - self.mean) / self.scale, at) @ self.weights
        for docs in self._groups(at):
            grid, real = self._layout(at, docs)
            unary = np.stack([np.zeros(grid.shape), score[grid]], axis=2)
            marginal, _ = forward_backward(unary, real, self.ties)
            weight = length[grid] * real
            good = (marginal[..., 1] * weight).sum(axis=1) / weight.sum(axis=1)
            good = np.clip(good, 1e-3, 1 - 1e-3)
            out[docs] = np.log(good / (1 - good))
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        out, lo = [], 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") <= CHUNK):
                held += len(texts[hi] or "")
                hi += 1
            out += _sigmoid(self.calibration[0] * self._raw(texts[lo:hi]) + self.calibration[1]).tolist()
            lo = hi
        return out


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text; other columns are not read).

    ``score`` is 0 to 1, higher where ``labels`` (doc_id, quality) would rather say 1; whole texts are scored.  The model is fitted on at
    most ``rows`` labelled documents outside the held-out fold, whole texts.  A null or empty text has no
    lines and takes the lowest evidence.  With labels of one class, or none, all scores are alike.  An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Model(sample(docs, labels, "quality", rows)))

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"].array, "score": sent.value.scores(pdf["text"].tolist())})

    own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = map_texts(own, work, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
