"""Language by Bayesian evidence fusion: text likelihoods, declared language, address suffix and host priors.

log posterior = log P(text | language) + log P(declared | language) + log P(language | host)

The host prior is smoothed towards the prior of the host's suffix, that one towards the prior of all rows; the counts are grouped
aggregations over all rows.  The text model is naive Bayes over the letter trigrams of words, fitted on a fixed number of rows of each declared
language, those of the smallest hashes, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.base import Tables, map_texts

SAMPLE_ROWS = 2_000        # rows the text model is fitted on, in equal parts by language
LEAST_ROWS = 20            # of each language, if it has as many
MARGIN = 4                 # times the wanted rows of a language that are expected under its first bound
LAST = 2**63 - 1           # no hash is larger
BINS = 1 << 16
TRUST = 0.9                # probability that a declared language is right
STRENGTH = 20.0            # rows that a smoothed prior weighs
PRIORS_SENT = 2_000_000    # numbers in the priors that are broadcast at most, 8 bytes each
BLOCK = 256                # languages whose text model is held at a time, 256 KB each
LETTER = r"\p{L}"
KEEP = 0.5                 # a document whose best language is less likely is rejected
CHUNK = 400_000            # characters that are looked up at a time


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, text) of every letter trigram inside a word, its ends marked, and each text's number of words (runs of letters)."""
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    mark = np.zeros(1, np.uint32)
    c = np.concatenate([mark] + [x for own in codes for x in (own, mark)] + [mark])
    letter = _letters()[c]
    c = np.where(letter, c, np.uint32(32))
    owner = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in codes])  # of each place but the first and last
    at = np.flatnonzero(letter[1:-1])
    h = (c[at] * np.uint32(0x01000193) ^ c[at + 1]) * np.uint32(0x01000193) ^ c[at + 2]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    words = np.bincount(owner[letter[1:-1] & ~letter[:-2]], minlength=len(texts))
    return (h >> np.uint32(16)).astype(np.int32), owner[at], words


class TextModel:
    """log P(trigram | language) in a table of BINS rows."""

    def __init__(self, languages: list[str], texts: list[tuple[str, str]]):
        self.languages = languages
        counts = np.full((BINS, len(languages)), 0.1)
        for k, x in enumerate(languages):
            bins, _, _ = trigrams([t for t, lang in texts if lang == x])
            counts[:, k] += np.bincount(bins, minlength=BINS)   # without a trigram the language's model stays flat
        self.table = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def scores(self, texts: list[str | None]) -> tuple[list[list[float]], list[int]]:
        """log P(text | language) of each language, and the number of words."""
        likelihood, words, lo = [], [], 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") <= CHUNK):
                held += len(texts[hi] or "")
                hi += 1
            bins, owner, n = trigrams(texts[lo:hi])
            per = [np.bincount(owner, self.table[bins, k], minlength=hi - lo) for k in range(len(self.languages))]
            likelihood += np.stack(per, axis=1).tolist()
            words += n.tolist()
            lo = hi
        return likelihood, words


def host_priors(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(host, prior): log P(language | host), smoothed to the suffix and to all rows.  rows: (host, suffix, declared)."""
    hosts = rows.groupBy("host", "suffix", "declared").agg(F.count("*").alias("n"))
    told = F.when(F.col("declared").isin(languages), F.struct("declared", "n"))
    by_host = hosts.groupBy("host", "suffix").agg(F.map_from_entries(F.collect_list(told)).alias("n"))  # a null isn't collected
    by_suffix = hosts.groupBy("suffix", "declared").agg(F.sum("n").alias("n"))
    whole = by_suffix.groupBy("declared").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(told)).alias("a"))  # one row
    by_suffix = by_suffix.groupBy("suffix").agg(F.map_from_entries(F.collect_list(told)).alias("s"))
    names = F.array(*[F.lit(x) for x in languages])

    def smooth(own: str, prior: Column) -> Column:
        total = F.aggregate(F.map_values(own), F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(names, prior, lambda x, p: (F.coalesce(F.try_element_at(F.col(own), x), F.lit(0)) + STRENGTH * p) / (total + STRENGTH))

    flat = F.array_repeat(F.lit(1.0 / len(languages)), len(languages))
    out = by_suffix.join(F.broadcast(whole)).withColumn("pa", smooth("a", flat))
    out = out.withColumn("ps", smooth("s", F.col("pa"))).select(F.col("suffix").alias("own"), "ps")
    out = by_host.join(out, F.col("suffix").eqNullSafe(F.col("own"))).drop("own")
    return out.select("host", "suffix", F.transform(smooth("n", F.col("ps")), lambda p: F.log(p)).alias("prior"))


def page_rows(pages: DataFrame) -> DataFrame:
    """(id, text, declared, host, suffix) of web pages (page_id, url, html): the lang attribute, the address's host and its last label, the text without tags."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    lang = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " ")
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), F.when(lang != "", lang).alias("declared"),
                        F.when(host != "", host).alias("host"), suffix_of(host).alias("suffix"))


def document_rows(docs: DataFrame) -> DataFrame:
    """(id, text, declared, host, suffix) of documents: the declared language is ``lang``, the host is ``source``."""
    host = F.lower(F.col("source").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"),
                       F.lower(F.col("lang").cast("string")).alias("declared"), host.alias("host"), suffix_of(host).alias("suffix"))


def suffix_of(host: Column) -> Column:
    """The last label of a host name of several labels, else null."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def _of(values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("declared"))


def _last_hashes(hashed: DataFrame, under: dict[str, int], each: int) -> dict[str, tuple[int, int]]:
    """Per declared language how many of its ``each`` smallest different hashes lie under its bound, and the last of them."""
    near = hashed.where(F.col("hash") <= _of(under)).select("declared", "hash").distinct()  # about MARGIN * each a language
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("declared").orderBy("hash"))).where(F.col("rank") <= each)
    found = {r.declared: (r.n, r.last) for r in ranked.groupBy("declared").agg(F.count(F.lit(1)).alias("n"), F.max("hash").alias("last")).collect()}
    return {d: found.get(d, (0, -2**63)) for d in under}


def sampled(lettered: DataFrame, languages: list[str]) -> DataFrame:
    """(id, declared, whole text) of as many rows of each language, those of the smallest hashes; repeated rows count once."""
    each = max(SAMPLE_ROWS // len(languages), LEAST_ROWS)
    hashed = lettered.where(F.col("declared").isin(languages)).withColumn("hash", F.xxhash64("id", "text"))
    # a language's smallest hashes lie under a bound that its number of different rows gives: one mergeable aggregation, no task for a language's rows
    different = hashed.groupBy("declared").agg(F.approx_count_distinct("hash").alias("n")).collect()
    under = {r.declared: int(-2**63 + 2**64 * min(1.0, MARGIN * each / r.n)) if r.n > MARGIN * each else LAST for r in different}
    last = _last_hashes(hashed, under, each)
    short = {d: LAST for d, (n, _hash) in last.items() if n < each and under[d] != LAST}
    if short:  # fewer than wanted lie under the bound: all of the language's rows are looked at
        last |= _last_hashes(hashed.where(F.col("declared").isin(list(short))), short, each)
    bound = _of({d: h for d, (_n, h) in last.items()})
    taken = hashed.where(F.col("hash") <= bound).select("id", "declared", "text")
    return taken.distinct().orderBy("declared", "id", "text")


def identify(rows: DataFrame) -> DataFrame:
    """(id, language, posterior, n_letter_words, declared, kept), one row per row of (id, text, declared, host, suffix).

    Any of the five may be null: a null is no evidence.  ``kept`` is false for a text without letters (language "und", posterior 0)
    and where the best language's posterior is under KEEP.  Ties go to the first language in the alphabet.  If no row declares
    a language there is nothing to tell: every row is "und".  An empty table gives no rows.
    """
    spark = rows.sparkSession
    tables = Tables(spark, "language")
    lettered = rows.where(F.col("declared").isNotNull() & F.col("text").rlike(LETTER))  # only these can be told or learned from
    counted = lettered.select("declared").distinct().collect()  # all of them, a name each
    languages = sorted(r.declared for r in counted)
    if not languages:
        words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(LETTER + "+"))
        return rows.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), words.cast("long").alias("n_letter_words"), "declared", F.lit(False).alias("kept"))
    learned = sampled(lettered, languages)
    blocks = [languages[lo:lo + BLOCK] for lo in range(0, len(languages), BLOCK)]
    if len(blocks) > 1:
        learned = tables.save(learned, "sample")

    def score(df: DataFrame, block: list[str], last: bool) -> DataFrame:
        """The rows, their likelihoods followed by those of the block's languages; the last block's without their texts."""
        sample = [(r.text, r.declared) for r in learned.where(F.col("declared").isin(block)).collect()]
        sent = spark.sparkContext.broadcast(TextModel(block, sample))

        def work(batches: Iterator[pd.DataFrame]):
            for pdf in batches:
                likelihood, words = sent.value.scores(pdf["text"].tolist())
                if "likelihood" in pdf:
                    likelihood = [[*a, *b] for a, b in zip(pdf["likelihood"], likelihood, strict=True)]
                yield (pdf.drop(columns="text") if last else pdf).assign(likelihood=likelihood, n_letter_words=words)

        return map_texts(df, work, ("" if last else "text string, ") + "id long, declared string, host string, suffix string, likelihood array<double>, n_letter_words long")

    scored = rows.select("id", "text", "declared", "host", "suffix")
    for k, block in enumerate(blocks):
        scored = score(scored, block, block is blocks[-1])
        if block is not blocks[-1]:  # one text model at a time in memory
            scored = tables.save(scored, f"scored-{k}")
            tables.drop(f"scored-{k - 1}")
    priors = tables.save(host_priors(rows, languages).withColumnRenamed("host", "h").withColumnRenamed("suffix", "s"), "priors")
    small = priors.count() * len(languages) <= PRIORS_SENT
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("suffix").eqNullSafe(F.col("s"))
    joined = scored.join(F.broadcast(priors) if small else priors, same, "left")
    n = max(len(languages), 2)
    names = F.array(*[F.lit(x) for x in languages])
    joined = joined.withColumn("at", F.coalesce(F.array_position(names, F.col("declared")), F.lit(0)))
    right, wrong = float(np.log(TRUST)), float(np.log((1 - TRUST) / (n - 1)))
    out = joined.withColumn("logs", F.transform(
        F.zip_with("likelihood", "prior", lambda t, p: t + p), lambda x, i: x + F.when(F.col("at") == 0, 0.0).when(F.col("at") == i + 1, right).otherwise(wrong)))
    out = out.withColumn("top", F.array_max("logs"))
    weight = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    known = (F.col("n_letter_words") > 0) & F.col("top").isNotNull()
    best = F.get(names, (F.array_position("logs", F.col("top")) - 1).cast("int"))
    out = out.select("id", F.when(known, best).otherwise("und").alias("language"), F.when(known, 1 / weight).otherwise(0.0).alias("posterior"), "n_letter_words", "declared")
    return out.withColumn("kept", (F.col("language") != "und") & (F.col("posterior") >= KEEP))
