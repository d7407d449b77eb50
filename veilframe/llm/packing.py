"""Best-fit decreasing packing of token sequences into windows of fixed size.

Documents are tokenized where they are read.  Each is first cut into full windows; its last piece,
shorter than a window, is packed with others.  Pieces are dealt to bins by a hash of (doc_id, start), a bin a task at a time, so every bin
gets a like mix of lengths and is packed on its own: a bin leaves at most a few unfilled windows, whatever the input's size.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm.base import Tables, map_texts

SIZE = 1024
END = 0
#: Latin letters, digits and common punctuation: classes that do not differ between Unicode versions.
_PLAIN = re.compile("[^\x00-ſ‐-‧]|<\\|")


@cache
def _encoders(name: str):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
    quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json")), quick


def token_ids(text: str | None, name: str = "byte_bpe_50k") -> np.ndarray:
    """The ids of ``text`` by the tokenizer file, without special tokens added.

    The same vocabulary's faster encoder is used where both must agree: plain Latin text without marks of special tokens.
    """
    whole, quick = _encoders(name)
    if not text:
        return np.empty(0, "<u4")
    if _PLAIN.search(text):
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(quick.encode_ordinary(text), "<u4")


class OpenWindows:
    """Windows by remaining capacity 1..size, with a segment tree over the capacities that are present.

    ``tightest(n)`` walks up from leaf n and down to the smallest capacity of at least n.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._change(capacity, 1)

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.windows[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece: longest first, into the open window that it fills most."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_windows, used = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        capacity = open_windows.tightest(n)
        if capacity is None:
            window[i], capacity = used, size
            used += 1
        else:
            window[i] = open_windows.take(capacity)
        offset[i] = size - capacity
        open_windows.add(capacity - n, int(window[i]))
    return window, offset


def pieces(docs: DataFrame, size: int = SIZE, name: str = "byte_bpe_50k", ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each row's token ids and a closing id 0, cut into windows."""
    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found = np.append(token_ids(text, name), np.uint32(END)).astype("<u4")
                for at in range(0, len(found), size):
                    piece = found[at:at + size]
                    rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(found), *([piece.tolist()] if ids else [])))
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * ids
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), work, schema)


def pack(docs: DataFrame, size: int = SIZE, name: str = "byte_bpe_50k", per_bin: int = 20_000, ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Every row of ``docs`` (doc_id, text; other columns are not read) is packed, repeated rows each on their own.  A null or
    empty text is its closing id alone.  ``sequence_id`` is unique over all bins; in a sequence the offsets are gapless from 0.
    An empty table gives no rows.  A bin holds about ``per_bin`` pieces, which bounds a task.
    """

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        window, offset = best_fit_decreasing(g["length"].to_numpy(), size)
        return g.assign(sequence_id=g["bin"].astype("int64") * (1 << 40) + window, offset=offset).drop(columns="bin")

    cut = Tables(docs.sparkSession, "packing").save(pieces(docs, size, name, ids), "pieces")
    bins = max(1, -(-cut.count() // per_bin))
    # rows that share all of these are equal pieces, and land in one bin however many they are: the row number spreads them
    key = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(bins)).cast("int")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return cut.withColumn("bin", key).groupBy("bin").applyInPandas(work, f"{columns}, sequence_id long, offset long")
