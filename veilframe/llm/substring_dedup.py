"""Passages repeated across or within documents, by Rabin-Karp hashes of every window of 20 words.

1. Each task hashes all windows of its rows with a rolling polynomial modulo 2**64 over word hashes.  It keeps one
   (hash, smallest doc_id) per distinct window, sorted and delta-coded into one blob per slice of the hash range, so a
   passage in many documents is combined before the shuffle.  Documents of the task that are not the smallest are
   reported at once: they hold a repeat whatever other tasks have.
2. Each slice finds the smallest doc_id of every hash and reports the other documents' entries, one blob for a bucket of documents.
3. A bucket gathers its documents' reports, which meet their documents again.  Windows reported, and those repeated inside the document, are
   removed; overlapping ones merge into maximal intervals.

Two different windows are taken for equal only if two 64-bit hashes collide: for n windows, about n**2 / 2**65 such pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.base import map_texts, mix, powers, word_hashes

WINDOW = 20
CHUNK = 400_000                   # windows that one task sorts at a time
SLICE_BYTES = 64 * 1024 * 1024    # text whose windows one slice of the hash range takes on average
NO_ID = np.iinfo(np.int64).max    # place of a null doc_id in the order of documents: that of the largest id


def _pack(values: np.ndarray) -> bytes:
    """64-bit integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).reshape(-1)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = []
    for at in range(0, n, 1 << 20):
        part = words[at:min(len(words), at + (1 << 20) + size - 1)]
        up, down = powers(len(part) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[:len(part)], dtype=np.uint64)])
        m = len(part) - size + 1
        out.append(mix((total[size:] - total[:m]) * down[:m]))
    return np.concatenate(out)


def _reports(order_hash: np.ndarray, order_doc: np.ndarray) -> np.ndarray:
    """In entries sorted by (hash, doc): those of a larger doc_id than their hash's first entry."""
    first = np.flatnonzero(np.concatenate([[True], order_hash[1:] != order_hash[:-1]]))
    run = np.repeat(np.arange(len(first)), np.diff([*first, len(order_hash)]))
    return order_doc > order_doc[first][run]


def _by_bucket(docs: np.ndarray, hashes: np.ndarray, buckets: int) -> pd.DataFrame:
    """One row (bucket, docs, hashes) for each bucket of documents that has pairs."""
    where = (mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, docs, where))
    where, docs, hashes = where[order], docs[order], hashes[order]
    cuts = np.flatnonzero(np.diff(where, prepend=-1))
    ends = np.append(cuts[1:], len(docs))[:len(cuts)]
    rows = [(int(where[x]), _pack(docs[x:y]), _pack(hashes[x:y])) for x, y in zip(cuts, ends, strict=True)]
    return pd.DataFrame(rows, columns=["bucket", "docs", "hashes"])


def _entries(docs: DataFrame, size: int, slices: int, buckets: int) -> DataFrame:
    """(slice, bucket, docs, hashes): sorted hashes of a slice with their smallest documents (bucket null), and reports on a bucket's documents."""
    step = np.uint64((1 << 64) // slices + 1)
    bounds = (np.arange(1, slices, dtype=np.uint64) * step)

    def flush(hashes: list, owners: list) -> pd.DataFrame:
        h, d = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h, d = h[fresh], d[fresh]
        late = _reports(h, d)
        out = _by_bucket(d[late], h[late], buckets)
        out["slice"] = out["bucket"] % slices
        lead = np.concatenate([[True], h[1:] != h[:-1]])
        h, d = h[lead], d[lead]
        held_by = np.searchsorted(bounds, h, side="right")
        cuts = np.flatnonzero(held_by[1:] != held_by[:-1]) + 1
        own = held_by[np.concatenate([[0], cuts])] if len(h) else []      # slices that have a window here
        parts = [(None, _pack(y), _pack_sorted(x), int(k)) for k, x, y in zip(own, np.split(h, cuts), np.split(d, cuts), strict=True)] if len(h) else []
        both = pd.concat([out.astype(object), pd.DataFrame(parts, columns=out.columns, dtype=object)], ignore_index=True)
        return both.astype({"slice": "int32", "bucket": "Int32"})

    def work(batches: Iterator[pd.DataFrame]):
        hashes, owners, held = [], [], 0
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy(np.int64)
            words, at = word_hashes(pdf["text"].tolist(), lower=False)
            for k in range(len(at) - 1):
                w = window_hashes(words[at[k]:at[k + 1]], size)
                if len(w):
                    hashes.append(w)
                    owners.append(np.full(len(w), ids[k], np.int64))
                    held += len(w)
                    if held >= CHUNK:
                        yield flush(hashes, owners)
                        hashes, owners, held = [], [], 0
        if held:
            yield flush(hashes, owners)

    return map_texts(docs.select("doc_id", "text"), work, "slice int, bucket int, docs binary, hashes binary")


def _settle(buckets: int):
    """Reports of one slice of the hash range, with the reports that it was handed: at most one row per bucket and source."""
    def work(g: pd.DataFrame) -> pd.DataFrame:
        blobs = g[g["bucket"].isna()]
        out = [g.loc[g["bucket"].notna(), ["bucket", "docs", "hashes"]]]
        if len(blobs):
            h = np.concatenate([_unpack_sorted(x) for x in blobs["hashes"]])
            d = np.concatenate([_unpack(x, np.int64) for x in blobs["docs"]])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            late = _reports(h, d)
            out.append(_by_bucket(d[late], h[late], buckets))
        return pd.concat(out, ignore_index=True).astype({"bucket": "int32"})

    return work


def _gather(g: pd.DataFrame) -> pd.DataFrame:
    """One row (doc_id, hashes) for each document of a bucket that has reports."""
    docs = np.concatenate([_unpack(x, np.int64) for x in g["docs"]])
    hashes = np.concatenate([_unpack(x, np.uint64) for x in g["hashes"]])
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    cuts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return pd.DataFrame({"doc_id": docs[cuts], "hashes": [_pack_sorted(x) for x in np.split(hashes, cuts[1:])]})


def _spans(words: np.ndarray, size: int, reported: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [start, end) of removed words."""
    w = window_hashes(words, size)
    gone = np.isin(w, reported) if len(reported) else np.zeros(len(w), bool)
    if len(w):
        again = np.ones(len(w), bool)
        again[np.unique(w, return_index=True)[1]] = False
        gone |= again
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(gone)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    covered = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=np.int8(0))
    return np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)


def remove_repeats(docs: DataFrame, size: int = WINDOW, slices: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, text), one row per row of ``docs`` (doc_id, text; of the others, those in ``carry``
    come along unchanged).

    Each word covered by a window of ``size`` words whose sequence also starts earlier (smaller doc_id, or same row,
    earlier start) is removed.  ``spans`` are the removed word intervals; ``text`` is the input without them, other white
    space kept.  A null text stays null and has no words.  Rows of equal doc_id don't remove each other's words.  A null
    doc_id counts as the largest possible one (2**63 - 1).  An empty table gives no rows.  ``slices`` of the hash
    range, and a quarter as many buckets of documents, bound a task's memory: unless given, four times spark.sql.shuffle.partitions
    or one for 64 MiB of text (about 11 million windows), whichever are more.
    """
    spark = docs.sparkSession
    carry = carry or []
    if slices is None:
        size_of = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        slices = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size_of // SLICE_BYTES))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.col("text").cast("string").alias("text"),
                        *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    buckets = max(1, slices // 4)
    reports = _entries(keyed, size, slices, buckets).groupBy("slice").applyInPandas(_settle(buckets), "bucket int, docs binary, hashes binary")
    found = reports.groupBy("bucket").applyInPandas(_gather, "doc_id long, hashes binary")

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = []
            words, at, s, e, data = word_hashes(pdf["text"].tolist(), lower=False, spans=True)
            for k, (doc, no_id, text, blob) in enumerate(zip(pdf["doc_id"], pdf["no_id"], pdf["text"], pdf["hashes"], strict=True)):
                own, own_s = words[at[k]:at[k + 1]], s[at[k]:at[k + 1]]
                begin, end = _spans(own, size, np.empty(0, np.uint64) if blob is None else _unpack_sorted(blob))
                if len(begin):
                    cut = np.concatenate([own_s, [len(data[k])]])
                    keep = zip(np.concatenate([[0], cut[end]]), np.concatenate([cut[begin], [len(data[k])]]), strict=True)
                    text = b"".join(data[k][x:y] for x, y in keep).decode("utf-8")
                rows.append((pd.NA if no_id else doc, len(own), int((end - begin).sum()),
                             [{"start": int(x), "end": int(y)} for x, y in zip(begin, end, strict=True)], text))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "spans", "text"]).astype({"doc_id": "Int64"}).assign(
                **{c: pdf[c].array for c in carried})

    carried = [f"carried_{i}" for i in range(len(carry))]
    types = "".join(f", {c} {keyed.schema[c].dataType.simpleString()}" for c in carried)
    out = map_texts(
        keyed.join(found, "doc_id", "left").select("doc_id", "no_id", "text", "hashes", *carried), work, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, text string" + types)
    return out.select("doc_id", "n_words", "n_removed", "spans", "text", *[F.col(c).alias(name) for c, name in zip(carried, carry, strict=True)])
