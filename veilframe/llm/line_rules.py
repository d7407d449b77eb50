"""Line-first cleaning with built-in expressions only: rules per line, then a verdict on what is left of the document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
END = list(".!?:;,…。！？\"'”’»)]")
BOILERPLATE = ["licensed under", "released under", "all rights reserved", "copyright", "cookie", "privacy policy", "terms of use",
               "terms of service", "subscribe", "click here", "read more", "skip to content"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The ``\\n``-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeated_starts(ranked: Column) -> Column:
    """Starts of windows found twice or more, in order, from all windows' (h, i) sorted: a neighbour has the same hash.

    ``ranked`` is a column, not an expression: inside the lambda an expression would be evaluated for each element.
    """
    twice = F.transform(ranked, lambda x, j: F.when(
        (F.get(ranked, j - 1)["h"] == x["h"]) | (F.get(ranked, j + 1)["h"] == x["h"]), x["i"]))
    return F.sort_array(F.filter(twice, lambda x: x.isNotNull()))


def has_boilerplate(lower: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(x)) for x in BOILERPLATE])


def line_fails(line: Column) -> Column:
    """Punctuation and navigation rules."""
    n_words = F.regexp_count(F.trim(line), F.lit(" ")) + 1
    ending = F.right(F.rtrim(line, F.lit(" \t\x0b\x0c\r")), F.lit(1))
    punctuation = ~ending.isin(END) | (F.regexp_count(line, F.lit("!")) > 1 + n_words / 2)
    navigation = F.regexp_count(line, F.lit(_SYMBOLS)) * 10 > n_words * 2
    return punctuation | navigation


def clean_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, text), one row per row of
    ``docs`` (doc_id, text; other columns are not read).

    ``text`` keeps the lines that pass every rule.  A document that fails the base rules or loses more than half of its
    word characters is not kept.  A null or empty text has no words and fails.  An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    out = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("words", words_of(F.col("text"))).withColumn("lines", lines_of(F.col("text")))
    out = out.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words").cast("long"))
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])))
    unique = F.size(F.array_distinct("windows")) == F.size("windows")
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("ranked", F.when(~unique, F.sort_array(pairs))).withColumn("starts", repeated_starts(F.col("ranked")))
    reach = F.transform("starts", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - x, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    whole = F.coalesce("text", F.lit(""))
    out = out.withColumn("n_symbols", F.regexp_count(whole, F.lit(_SYMBOLS)).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("lower", F.lower(whole))
    # most texts hold no phrase: one look at the whole text spares a look at each line
    some, boilerplate = has_boilerplate(F.col("lower")), lambda x: has_boilerplate(F.lower(x))

    def lines(rule, with_phrases) -> Column:
        return F.when(some, F.filter("lines", with_phrases)).otherwise(F.filter("lines", rule))

    bad = F.array_join(lines(line_fails, lambda x: line_fails(x) | boilerplate(x)), "")
    lost = F.length(F.regexp_replace(bad, _SPACE, "")).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (100 * lost <= MAX_LOST_PERCENT * F.col("word_chars"))
    good = lines(lambda x: ~line_fails(x), lambda x: ~(line_fails(x) | boilerplate(x)))
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))
    # A row of one: a filter on these columns stays above it.  Pushed down it would take the place of the columns that
    # the lambdas refer to, and be evaluated for each element.
    return out.select("doc_id", F.array_join(good, "\n").alias("text"), F.inline(F.array(found))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "text")
