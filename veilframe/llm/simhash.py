"""Near-duplicate documents by SimHash, compared exactly in tiles.

1. A document's fingerprint has a bit set where over half of its shingles' hashes have it set.
2. Distinct fingerprints are sorted by their population counts: of all 64 bits, then of halves, quarters and eighths, so that
   neighbours have like counts.  Runs of ``STRIP`` of them travel as one blob.
3. Two fingerprints differ in at least as many bits as their counts differ, summed over the halves, quarters or eighths.  Strips whose counts
   of all 64 bits differ beyond the radius never meet (an equi-join on the counts that a strip reaches); in a task, neither do
   tiles of ``TILE`` fingerprints whose ranges of counts are too far apart.  All other tiles are compared in full: exclusive-or, bit count.
4. A task joins its links at once and hands on at most one edge a fingerprint, so a large group of near copies is never
   written as pairs.  Edges are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.base import Tables, components, map_texts

SIZE, SEED, RADIUS = 4, 42, 4
STRIP = 1 << 16    # fingerprints in a blob: half a megabyte
TILE = 512
PAIRS = 8          # pairs of strips for a task
_ROUND = 1 << 16   # hashes whose bits are counted at a time

#: Masks of the whole, the halves, the quarters and the eighths of 64 bits; ``_LEVELS`` are their places in the list.
_MASKS = [((1 << width) - 1) << at for width in (64, 32, 16, 8) for at in range(0, 64, width)]
_LEVELS = [slice(0, 1), slice(1, 3), slice(3, 7), slice(7, 15)]
#: Every second part: the other one's count follows from the part that both lie in.
_ORDER = [_MASKS[0], _MASKS[1], *_MASKS[3:7:2], *_MASKS[7:15:2]]


def fingerprint(text: str | None, size: int = SIZE) -> int:
    """The 64-bit fingerprint of a text's shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # both know ASCII only
    if not words:
        return 0
    size = min(size, len(words))
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    n = len(words) - size + 1
    starts = (ends - length)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[size - 1:].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _ROUND):
        part = hashes[at:at + _ROUND]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row."""
    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            found = np.array([fingerprint(t, size) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fingerprint": found.view(np.int64)})

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), work, "doc_id long, fingerprint long")


class Boxes:
    """Ranges of the population counts of each tile of a strip."""

    def __init__(self, prints: np.ndarray):
        counts = np.stack([np.bitwise_count(prints & np.uint64(m)) for m in _MASKS], axis=1).astype(np.int16)
        cuts = np.arange(0, len(prints), TILE)
        self.low, self.high = np.minimum.reduceat(counts, cuts), np.maximum.reduceat(counts, cuts)

    def least(self, k: int, other: Boxes) -> np.ndarray:
        """The fewest bits in which a fingerprint of tile k can differ from one of each of the other's tiles."""
        gap = np.maximum(np.maximum(self.low[k] - other.high, other.low - self.high[k]), 0)
        return np.max([gap[:, level].sum(axis=1) for level in _LEVELS], axis=0)


def _join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the sets of x[i] and y[i] for all i; ``root`` holds each element's smallest joined one."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, joined fingerprint) that join all pairs within the radius between two strips, or inside one (``right`` is None)."""
    both = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    other = left if right is None else right
    root = np.arange(len(both))
    own, far = Boxes(left), Boxes(other)
    buffer = np.empty((TILE, TILE), np.uint64)
    for k in range(len(own.low)):
        a = left[k * TILE:(k + 1) * TILE]
        near = np.flatnonzero(own.least(k, far) <= radius)
        hits = []
        for t in near[near >= k] if right is None else near:
            b = other[t * TILE:(t + 1) * TILE]
            x, y = np.nonzero(np.bitwise_count(np.bitwise_xor(a[:, None], b[None, :], out=buffer[:len(a), :len(b)])) <= radius)
            if right is None and t == k:
                x, y = x[x < y], y[x < y]
            if len(x):
                hits.append((x + k * TILE, y + t * TILE + shift))
        if hits:
            _join(root, np.concatenate([x for x, _ in hits]), np.concatenate([y for _, y in hits]))
    moved = np.flatnonzero(root != np.arange(len(both)))
    return both[moved], both[root[moved]]


def _strips(prints: DataFrame, strip: int) -> DataFrame:
    """(blob, low, high): runs of sorted fingerprints and the range of their population counts."""
    order = [F.bit_count(F.col("fingerprint").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for m in _ORDER]

    def work(batches: Iterator[pd.DataFrame]):
        def rows(x: np.ndarray) -> pd.DataFrame:
            count = np.bitwise_count(x)
            return pd.DataFrame({"blob": [x.tobytes()], "low": [int(count.min())], "high": [int(count.max())]})

        held = np.empty(0, np.uint64)
        for pdf in batches:
            held = np.concatenate([held, pdf["fingerprint"].to_numpy(np.int64).view(np.uint64)])
            while len(held) >= strip:
                yield rows(held[:strip])
                held = held[strip:]
        if len(held):
            yield rows(held)

    dealt = prints.select("fingerprint").repartitionByRange(*order, "fingerprint").sortWithinPartitions(*order, "fingerprint")
    return dealt.mapInPandas(work, "blob binary, low int, high int")


def edges(prints: DataFrame, tables: Tables, radius: int = RADIUS, strip: int = STRIP) -> DataFrame:
    """(a, b): edges that join all distinct fingerprints (fingerprint) within the radius of each other."""
    strips = tables.save(_strips(prints, strip).withColumn("strip", F.monotonically_increasing_id()), "strips")
    held = strips.select("strip", F.explode(F.sequence("low", "high")).alias("count"))
    reached = strips.select(F.col("strip").alias("j"), F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("count"))
    pairs = tables.save(held.join(reached, "count").where("strip <= j").select(F.col("strip").alias("i"), "j").distinct(), "pairs")
    tasks = max(1, -(-pairs.count() // PAIRS))
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("strip"))
    dealt = sides.join(strips.select("strip", "blob"), "strip").repartition(tasks, "i", "j")

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("strip")
        blobs = [np.frombuffer(x, np.uint64) for x in g["blob"]]
        a, b = linked(blobs[0], blobs[1] if len(blobs) > 1 else None, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return tables.save(dealt.groupBy("i", "j").applyInPandas(work, "a long, b long"), "edges")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs`` (doc_id, text; other columns are not read).

    Texts are lower-cased (A-Z) and cut into words; a text with fewer words than ``size`` is one shingle, one that is null, empty or
    without words has fingerprint 0, which is linked like any other.  Documents are linked if their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest doc_id reachable.  Rows of one doc_id are one document.  A row without doc_id is linked with nothing
    (component_id null).  An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "simhash")
    signed = tables.save(fingerprints(docs, size), "signed")
    full = signed.where("doc_id IS NOT NULL")
    classes = tables.save(full.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    near = edges(classes, tables, radius)
    # a document of several texts joins all their fingerprints to its smallest one
    several = full.groupBy("doc_id").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("z")).where("b <> z").drop("z")
    several = tables.save(several, "several")
    if not several.isEmpty():
        near = near.unionByName(full.join(several, "doc_id").where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b"))
    labels = components(tables, near, "joined").withColumnRenamed("node", "fingerprint")
    placed = classes.join(labels, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    lowest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = tables.save(placed.join(lowest, "component").select("fingerprint", "component_id"), "named")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    out = signed.join(named, "fingerprint", "left").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), own)
    tables.drop("strips", "pairs", "edges", "several", "classes")
    return out
