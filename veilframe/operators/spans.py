"""Personal data inside free text, each span with its own technique.

1. Every configured rule's matches in the whole text are candidates, with positions: the lengths of the pieces between the matches and of the
   matches themselves add up to them.
2. Candidates may overlap (a card number also reads as a phone number).  They are taken by rank, then leftmost first; one that
   overlaps a span already taken is left out.  (Matches of one rule never overlap, so no two of a rank start at one place.)
3. The text is put together again from the pieces between the spans and each span after its technique.

All of it is one projection of built-in expressions over the row's own text: no shuffle, no Python.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX
from veilframe.functions.fakes import DEFAULT_LOCALE, SEED, fake_value
from veilframe.functions.techniques import technique_column
from veilframe.functions.text import col, is_blank, py_strip, unicode_pattern
from veilframe.operators.detect import NEEDS_DIGIT
from veilframe.session import spread

_SPAN = "array<struct<start: int, end: int, rank: int, value: string>>"


def _matches(text: Column, rank: int, pattern: str) -> Column:
    """The rule's matches (start, end, rank, value), positions in characters from 0."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), x["value"].alias("value"))
        # behind the last match there is a gap alone
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["found"], span).alias("found")))

    return F.aggregate(pairs, nothing, step, lambda acc: acc["found"])


def spans(text: Column, types: list[str] | None = None, rules=None, unicode: bool = False) -> Column:
    """The spans (start, end, rank, value) of a text in the order of their places; null for a null text.

    ``types``: only rules of these types (None: all) are looked for.
    """
    found = []
    for rank, name, _keywords, pattern, _default in list(rules or FX.PII_RULES):
        if types is not None and name not in types:
            continue
        own = _matches(text, rank, unicode_pattern(pattern, unicode))
        if rules is None and not unicode and (name in NEEDS_DIGIT or name == FX.EMAIL):
            # most texts are told apart by a character that every match holds
            may = F.contains(text, F.lit("@")) if name == FX.EMAIL else text.rlike("[0-9]")
            own = F.when(may, own).otherwise(F.array().cast(_SPAN))
        found.append(own)
    if not found:
        return F.when(text.isNotNull(), F.array().cast(_SPAN))

    def take(taken: Column, c: Column) -> Column:
        hit = F.exists(taken, lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"]))
        return F.when(hit, taken).otherwise(F.array_append(taken, c))

    # candidates stand in order of rank, then of place
    taken = F.aggregate(F.concat(*found), F.array().cast(_SPAN), take)
    return F.when(text.isNotNull(), F.array_sort(taken))


def span_table(df: DataFrame, key: list[str], column: str, types: list[str] | None = None, rules=None, unicode: bool = False) -> DataFrame:
    """(key columns, start, end, pii_type, value): one row per span; texts without one have no row."""
    df = spread(df)
    names = {r[0]: r[1] for r in list(rules or FX.PII_RULES)}
    name = F.element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), F.col("s.rank"))
    rows = df.select(*[col(c) for c in key], F.explode(spans(col(column), types, rules, unicode)).alias("s"))
    return rows.select(*[col(c) for c in key], F.col("s.start").alias("start"), F.col("s.end").alias("end"), name.alias("pii_type"), F.col("s.value").alias("value"))


def protect_spans(df: DataFrame, column: str, config: dict[str, str], rules=None, unicode: bool = False, salt: Column | str | None = None,
                  locale: str = DEFAULT_LOCALE, seed: Column | str = SEED) -> DataFrame:
    """``df`` with the spans of ``column`` protected; other columns unchanged.

    ``config``: type -> technique.  Types without an entry are left alone and take no part in overlaps; an unknown technique warns and leaves its spans.  Fakes
    are those of ``fakes.fake_value`` (one per type and value), and ``span_mapping`` is their key.  Null texts stay null.
    """
    rules_by_rank = {r[0]: r[1] for r in list(rules or FX.PII_RULES) if r[1] in config}
    text = col(column)

    def protected(x: Column) -> Column:
        v, out = x["value"], x["value"]
        for rank, name in rules_by_rank.items():
            if config[name] == FX.FAKE_DATA:
                own = F.when(is_blank(v), v).otherwise(fake_value(name, py_strip(v), locale, seed))
            else:
                own = technique_column(v, config[name], name, unicode=unicode, salt=salt)
            if own is None:
                warnings.warn(f"unknown technique {config[name]!r} for {name!r}; unchanged")
                continue
            out = F.when(x["rank"] == rank, own).otherwise(out)
        return out

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(gap, protected(x))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(spans(text, list(config), rules, unicode), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))
    return spread(df).withColumn(column, whole)


def span_mapping(df: DataFrame, column: str, config: dict[str, str], rules=None, unicode: bool = False,
                 locale: str = DEFAULT_LOCALE, seed: Column | str = SEED) -> DataFrame:
    """The key ``(original, fake, pii_type, n)`` of the Fake Data spans that ``protect_spans`` replaces."""
    faked = [t for t, technique in config.items() if technique == FX.FAKE_DATA]
    # all configured types take part in overlaps
    found = span_table(df, [], column, list(config), rules, unicode).where(F.col("pii_type").isin(*faked))
    found = found.groupBy(py_strip(F.col("value")).alias("original"), "pii_type").agg(F.count(F.lit(1)).alias("n"))
    fake = F.lit(None).cast("string")
    for t in faked:
        fake = F.when(F.col("pii_type") == t, fake_value(t, F.col("original"), locale, seed)).otherwise(fake)
    return found.select("original", fake.alias("fake"), "pii_type", "n")
