"""Near-duplicate documents by HyperMinHash.

Each distinct word shingle is hashed to one of 128 buckets.  A bucket keeps the smallest hash as
its leading-zero count and the 9 mantissa bits behind the leading one (a 16-bit register).  A bucket that no shingle
reached keeps the smallest of all shingles under a hash of its own, marked by the register's top bit, so short
documents fill every register too and two registers agree with the Jaccard similarity.

1. Documents with equal shingle sets become one class; only classes go on.
2. Each band of 4 compressed registers is a bucket key.  A class meets one pseudo-random centre per key, so a
   hot key costs one pair per member, not all pairs.
3. The share of equal registers, less the chance collisions of the mantissas, estimates the similarity; pairs
   estimated under ``ESTIMATE`` are left out (5 standard errors under the threshold), the rest are verified on full sets.
4. Verified links are joined to components.  Keys that still hold several components are then compared
   across components, block against block, so no link between different texts is lost to step 2.  There a pair is looked at under
   its first equal band alone, by registers and then by sets of 32-bit hashes, which can only raise a similarity; what passes is verified.

Bands of 4 miss a pair at similarity 0.8 with probability 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.base import Tables, components, map_texts, mix, word_hashes

REGISTERS, BAND, MANTISSA = 128, 4, 9
BANDS = REGISTERS // BAND
ESTIMATE = 0.60
BLOCK = 1_000_000      # shingles in one block of a key's classes; blocks are compared two at a time
SENT = 1_000_000       # document ids that are broadcast at most, 8 bytes each
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_TOP = np.uint64(REGISTERS.bit_length() - 1)
_BITS = 64 - int(_TOP)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words than ``size``, of the whole sequence."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix(h + words[k:k + n])
    return np.unique(h)


def _bit_length(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1]


def registers(found: np.ndarray) -> np.ndarray:
    """The 128 registers (uint16) of a non-empty set of hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, (found & np.uint64(REGISTERS - 1)).astype(np.int64), found >> _TOP)
    empty = np.flatnonzero(low == np.iinfo(np.uint64).max)
    if len(empty):
        step = max(1, (1 << 20) // len(empty))
        for at in range(0, len(found), step):
            own = mix(found[at:at + step, None] ^ _SEEDS[None, empty]) >> _TOP
            low[empty] = np.minimum(low[empty], own.min(axis=0))
    length = np.minimum(_bit_length(low), _BITS)
    zeros = (_BITS - length).astype(np.uint64)
    lead = low << (np.uint64(64) - np.maximum(length, 1).astype(np.uint64))
    mantissa = (lead << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = (zeros << np.uint64(MANTISSA)) | mantissa
    out[empty] |= np.uint64(1 << 15)
    return out.astype("<u2")


def _chance_table() -> np.ndarray:
    """Probability that two unrelated registers agree, by the base-2 logarithms of the set sizes."""
    n = 2.0 ** np.arange(41)
    edge = 2.0 ** -np.arange(_BITS + 1)
    own = np.exp(-n / REGISTERS)
    parts = []
    for rate, weight in ((n / REGISTERS, np.ones_like(n)), (n, own)):
        below = np.exp(-rate[:, None] * edge[None, 1:]) - np.exp(-rate[:, None] * edge[None, :-1])
        parts.append(below * weight[:, None])
    cell = np.concatenate(parts, axis=1)
    return cell @ cell.T / (1 << MANTISSA)


_CHANCE = _chance_table()


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of registers (rows of ``a`` against rows of ``b``)."""
    share = (a == b).mean(axis=-1)
    chance = _CHANCE[np.log2(n_a).astype(int), np.log2(n_b).astype(int)]
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u2").reshape(-1, REGISTERS)


def _possible(a, b, n_a, n_b, percent: int) -> np.ndarray:
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return fits & (jaccard_estimate(a, b, n_a, n_b) >= ESTIMATE - (80 - percent) / 100)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, print, registers) of every row with words; ``print`` names the set."""
    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            words, at = word_hashes(pdf["text"].tolist(), lower=True)
            rows = []
            for i, doc in enumerate(pdf["doc_id"]):
                found = shingles(words[at[i]:at[i + 1]], size)
                full = len(found) > 0
                rows.append((doc, len(found), xxhash.xxh3_128_digest(found.tobytes()) if full else None,
                             registers(found).tobytes() if full else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "print", "registers"]).astype({"doc_id": "Int64"})

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")),
                     work, "doc_id long, n_shingles long, print binary, registers binary")


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            sets = []
            for column in ("text_a", "text_b"):
                which, unique = pd.factorize(pdf[column])
                words, at = word_hashes(list(unique), lower=True)
                made = [shingles(words[at[i]:at[i + 1]], size) for i in range(len(unique))]
                sets.append([made[k] for k in which])
            good = []
            for x, y in zip(*sets, strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pdf.loc[good, ["a", "b"]]

    return map_texts(both.select("a", "b", "text_a", "text_b"), work, "a long, b long").distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, estimate) of the pairs whose registers and sizes allow the threshold."""
    def side(name: str) -> DataFrame:
        return classes.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            if len(pdf):
                a, b = _matrix(pdf["r_a"]), _matrix(pdf["r_b"])
                n_a, n_b = pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy()
                out = pdf[["a", "b"]].assign(estimate=jaccard_estimate(a, b, n_a, n_b))
                yield out[_possible(a, b, n_a, n_b, percent)]

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return joined.mapInPandas(work, "a long, b long, estimate double")


def _short_sets(texts: DataFrame, size: int) -> DataFrame:
    """(rep, print, short): the sets as sorted distinct 32-bit hashes."""
    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            words, at = word_hashes(pdf["text"].tolist(), lower=True)
            made = [shingles(words[at[i]:at[i + 1]], size) for i in range(len(pdf))]
            yield pd.DataFrame({"rep": pdf["doc_id"], "print": [xxhash.xxh3_128_digest(x.tobytes()) for x in made],
                                "short": [np.unique((x >> np.uint64(32)).astype("<u4")).tobytes() for x in made]})

    return map_texts(texts, work, "rep long, print binary, short binary")


class _Joined:
    """Components of one group, joined as links are found."""

    def __init__(self, names: np.ndarray):
        self.now = names.copy()

    def join(self, a, b) -> None:
        if a != b:
            self.now[self.now == max(a, b)] = min(a, b)


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a key and may be linked.

    members: (key, weight, band, rep, component, n, registers, short).  A key of many shingles is dealt into blocks, and
    each pair of blocks is one group of about 2 * BLOCK shingles.
    """
    blocks = F.ceil(F.col("weight") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "key"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("weight", "other")

    def pairs(g: pd.DataFrame) -> list[tuple[int, int]]:
        i, j, band = int(g["i"].iloc[0]), int(g["j"].iloc[0]), int(g["band"].iloc[0])
        own, rep, n = g["own"].to_numpy(), g["rep"].to_numpy(), g["n"].to_numpy()
        regs = _matrix(g["registers"])
        bands = np.ascontiguousarray(regs).view("<u8")
        short = [np.frombuffer(x, "<u4") for x in g["short"]]
        joined = _Joined(g["component"].to_numpy())
        right = np.flatnonzero(own == j)
        out = []
        for x in np.flatnonzero(own == i):
            y = right[(joined.now[right] != joined.now[x]) & (rep[right] != rep[x])]
            y = y[y > x] if i == j else y
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            if len(y) and band:
                y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
            if len(y):
                y = y[_possible(regs[x][None, :], regs[y], np.full(len(y), n[x]), n[y], percent)]
            for k in y:
                if joined.now[k] != joined.now[x]:
                    shared = len(np.intersect1d(short[x], short[k], assume_unique=True)) + _lost(n[x], short[x]) + _lost(n[k], short[k])
                    total = int(n[x] + n[k])
                    if 100 * shared >= percent * (total - shared):
                        out.append((min(rep[x], rep[k]), max(rep[x], rep[k])))
                        sure = shared - 4  # chance agreements of 32 bits
                        if 100 * sure >= percent * (total - sure):
                            joined.join(joined.now[x], joined.now[k])
        return out

    def work(batches: Iterator[pd.DataFrame]):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            change = (pdf[["key", "i", "j"]] != pdf[["key", "i", "j"]].shift()).any(axis=1).to_numpy()
            cuts = [*np.flatnonzero(change), len(pdf)]
            out = [p for s, e in zip(cuts[:-2], cuts[1:-1], strict=True) for p in pairs(pdf.iloc[s:e])]
            rest = pdf.iloc[cuts[-2]:] if len(pdf) else None
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if rest is not None:
            yield pd.DataFrame(pairs(rest), columns=["a", "b"], dtype="int64")

    groups = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return groups.mapInPandas(work, "a long, b long").distinct()


def _lost(n: int, short: np.ndarray) -> int:
    """Shingles of a set that fell together in 32 bits."""
    return int(n) - len(short)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text; other columns are not read).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; ``percent`` is 80 or more.
    component_id is the smallest doc_id reachable; kept: doc_id = component_id.  A text that is null, empty or without words
    has 0 shingles and is linked with nothing.  Rows of one doc_id are one document.  A row without doc_id is kept
    and linked with nothing (component_id null).  An empty table gives no rows.
    """
    if not 80 <= percent <= 100:
        raise ValueError("bands are laid out for similarities from 0.8 on")
    spark = docs.sparkSession
    tables = Tables(spark, "near")
    signed = tables.save(signatures(docs, size), "signed")
    full = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    named = tables.save(full.groupBy("print").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.first("registers").alias("registers")), "classes")
    classes = named.select("rep", "n", "registers")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * (2 * BAND) + 1, F.lit(2 * BAND))))
    entries = classes.select("rep", "n", F.posexplode(bands).alias("band", "key"))
    mask = F.col("rep").bitwiseXOR(F.col("key"))
    hubs = entries.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min(mask).alias("low")).where("size > 1")
    shared = tables.save(entries.join(hubs, "key").select("key", "band", "weight", "rep", F.col("low").bitwiseXOR(F.col("key")).alias("hub")), "shared")
    star = shared.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    tested = tables.save(_estimated(star, classes, percent), "tested")
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))

    def texts(ids: DataFrame, name: str) -> DataFrame:
        ids = tables.save(ids.distinct(), f"{name}-ids")
        found = wanted.join(F.broadcast(ids) if ids.count() <= SENT else ids, "doc_id", "left_semi")
        return tables.save(found.distinct(), name)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))

    def joined(links: DataFrame, name: str) -> DataFrame:
        return tables.save(components(tables, links, f"{name}-c"), name)

    def component(ids: DataFrame, key: str, labels: DataFrame, to: str) -> DataFrame:
        found = labels.select(F.col("node").alias(key), F.col("component").alias(to))
        return ids.join(found, key, "left").withColumn(to, F.coalesce(F.col(to), F.col(key)))

    # one document of several texts joins all their classes to the smallest
    held = full.join(named.select("print", "rep"), "print").select("doc_id", F.col("rep").alias("b"))
    many = tables.save(held.groupBy("doc_id").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z").drop("z"), "many")
    same = tables.save(held.join(many, "doc_id").where("a <> b").select("a", "b").distinct(), "same") if not many.isEmpty() else many.select("a", F.col("a").alias("b"))
    best = tested.groupBy("b").agg(F.max_by("a", "estimate").alias("a"))
    near = texts(ends(tested), "near")
    links = tables.save(_verify(best, near, size, percent), "links-1").unionByName(same)
    labels = joined(links, "labels-1")
    rest = component(component(tested.join(best, ["a", "b"], "left_anti"), "a", labels, "ca"), "b", labels, "cb").where("ca <> cb")
    links = links.unionByName(tables.save(_verify(rest.select("a", "b"), near, size, percent), "links-2"))
    labels = joined(links, "labels-2")

    placed = component(shared, "rep", labels, "component")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    placed = tables.save(placed.join(mixed, "key", "left_semi").drop("hub"), "mixed")
    sets = _short_sets(texts(placed.select(F.col("rep").alias("doc_id")), "mixed-texts"), size).join(named.drop("copies"), ["print", "rep"]).drop("print")
    open_pairs = tables.save(_across(placed.join(sets, "rep"), percent).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "open")
    last = tables.save(_verify(open_pairs, texts(ends(open_pairs), "open-texts"), size, percent), "links-3")
    labels = joined(links.unionByName(last), "labels-3")

    rep = named.select("print", "rep")
    by_class = component(rep, "rep", labels, "component_id").select("print", "component_id")
    out = signed.join(by_class, "print", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    tables.drop("shared", "tested", "near", "mixed", "mixed-texts", "open", "open-texts", "labels-1", "labels-2")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
