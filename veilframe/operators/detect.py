"""Find personal data by column name and by values.

* Header pass (D2): the column catalog (one row per column, built from
  schemas) is theta-joined to the keyword list of the rule table (a fixed
  table of ~60 keywords, broadcast); the lowest-ranked matching type wins.
* Value pass (D3-D5): the columns the header pass missed are unpivoted into
  ``(column, text)`` and aggregated once: per column the non-empty count and
  one conditional sum per rule.  The group key is the column name, so
  partial aggregation leaves one row per column per task before the shuffle.
  By default every row is used; ``sample_rows=n`` uses the
  first ``n`` non-null cells per column by ``key``, or in file order (a top-n of each column over that
  column and the key alone, planned as ``TakeOrderedAndProject``: a task holds ``n`` cells and sorts no input).
* Text spans (D12, P16): span counts and span redaction inside long text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import fixed as FX
from veilframe.functions.text import as_text, col, is_non_empty, py_strip, sql_string, unicode_pattern
from veilframe.session import spread
from veilframe.sources import file_order

ATOMIC = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType,
          T.TimestampNTZType)


def _rules(rules):
    return list(rules or FX.PII_RULES)


def is_atomic(dtype: T.DataType) -> bool:
    return isinstance(dtype, ATOMIC)


# ---------------------------------------------------------------------------
# Header pass
# ---------------------------------------------------------------------------

def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Column catalog ``(table_name, column_name, ordinal, data_type)`` from schemas."""
    rows = []
    for t, df in tables.items():
        for i, f in enumerate(df.schema.fields):
            rows.append((t, f.name, i + 1, f.dataType.simpleString()))
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string")


def keyword_rows(rules=None) -> list[tuple[int, str, str]]:
    """(rank, type, keyword), the table behind both header paths."""
    return [(r[0], r[1], kw) for r in _rules(rules) for kw in r[2]]


def keywords_df(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(keyword_rows(rules), "rank int, pii_type string, keyword string")


def detect_headers(cat: DataFrame, rules=None, column: str = "column_name") -> DataFrame:
    """``cat`` + ``pii_type`` (null when no keyword is a substring of the
    lower-cased, stripped name).  Theta join against a fixed keyword table."""
    spark = cat.sparkSession
    kw = keywords_df(spark, rules)
    name = F.lower(py_strip(F.col(column)))
    hits = cat.join(F.broadcast(kw), name.contains(F.col("keyword")), "inner")
    keys = [c for c in cat.columns]
    best = hits.groupBy(*keys).agg(F.min_by("pii_type", "rank").alias("pii_type"))
    return cat.join(best, keys, "left")


def header_type(name: str, rules=None) -> str | None:
    """D2 for a single name (driver-side, no data involved)."""
    n = name.strip().lower()
    hits = [(rank, t) for rank, t, kw in keyword_rows(rules) if kw in n]
    return min(hits)[1] if hits else None


# ---------------------------------------------------------------------------
# Value pass
# ---------------------------------------------------------------------------

def value_cells(df: DataFrame, columns: list[str], key: str | None = None,
                sample_rows: int | None = None) -> DataFrame:
    """Unpivot ``columns`` into ``(column, v)`` text cells (nulls dropped,
    like ``dropna``).  With ``sample_rows`` keep the first n per column, by key or, without one, in file order
    (``file_order``: ``df`` must be read from files; only the leading files that hold n cells of a column are read for it)."""
    if sample_rows is not None and key is None:
        return first_cells(df, columns, sample_rows)
    texts = {c: as_text(col(c), df.schema[c].dataType) for c in columns}
    if sample_rows is not None:
        firsts = [df.select(col(key).alias("_key"), texts[c].alias("v")).where(F.col("v").isNotNull()).orderBy("_key").limit(sample_rows)
                  .select(F.lit(c).alias("column"), "v") for c in columns]
        return reduce(DataFrame.unionByName, firsts)
    long = df.select(*[t.alias(c) for c, t in texts.items()]).unpivot([], [col(c) for c in columns], "column", "v")
    return long.where(F.col("v").isNotNull())


def first_cells(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The first ``n`` cells (nulls left out) of each column in file order."""
    present = {c: as_text(col(c), df.schema[c].dataType).isNotNull() for c in columns}
    cells = None
    for names, part in file_order.first_parts(df, columns, present, n):
        place = file_order.fresh_name(df, "__place")
        part = value_cells(file_order.placed(part, place), names, place, n)
        cells = part if cells is None else cells.unionByName(part)
    return cells


# --- built-in rules that can match the text of a typed value ------------------
# Numbers print with digits, '.', '-', '+' and 'e' only (NaN is null
# here, 'inf' has no digits): Email needs '@', Full Name and ID need
# letters, Address needs whitespace, CNIC / DOB need two separators between
# digit groups and IP three dots, so none of them can match.  Dates and
# timestamps print as 'yyyy-MM-dd[ HH:mm:ss[.f]]': no letters or '@', at most
# one dot, and the one space is followed by a digit, so Email, Full Name, ID,
# Address, IP and CNIC cannot match.  Booleans print as 'true' / 'false'.
NUMBER_CAPABLE = {FX.PHONE, FX.CREDIT_CARD, FX.AGE}
TEMPORAL_CAPABLE = {FX.PHONE, FX.CREDIT_CARD, FX.DOB, FX.AGE}
BOOLEAN_CAPABLE: set[str] = set()
# every match of these built-in patterns contains an ASCII digit ([0-9] in
# ASCII mode); every Email match contains '@'
NEEDS_DIGIT = {FX.PHONE, FX.CNIC, FX.DOB, FX.ADDRESS, FX.IP_ADDRESS, FX.CREDIT_CARD,
               FX.STUDENT_ID, FX.AGE}
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def capable_rules(dtype: T.DataType) -> set[str] | None:
    """Built-in types that can match the text of ``dtype`` (None: all)."""
    if isinstance(dtype, T.NumericType):
        return NUMBER_CAPABLE
    if isinstance(dtype, _TEMPORAL):
        return TEMPORAL_CAPABLE
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN_CAPABLE
    return None


def value_stats(cells: DataFrame, rules=None, unicode: bool = False,
                capable: dict[str, set[str] | None] | None = None) -> DataFrame:
    """Per column ``total`` non-empty cells and ``hits_<rank>`` per rule.

    ``capable`` maps a column to the built-in types its typed text can match
    (None: any).  Typed cells are never blank, and a rule is only evaluated
    on the columns that can match it: the column-name test comes first in a
    short-circuit AND, so skipped cells cost no regex."""
    rs = _rules(rules)
    capable = capable or {}
    typed = [c for c, k in capable.items() if k is not None]
    name = F.col("column")
    needs = {}
    if rules is None and not unicode:
        # cheap per-cell prerequisites, computed once in the projection
        cells = cells.withColumn("_d", F.col("v").rlike("[0-9]")) \
            .withColumn("_at", F.instr(F.col("v"), "@") > 0)
        needs = {t: F.col("_d") for t in NEEDS_DIGIT}
        needs[FX.EMAIL] = F.col("_at")
    ne = F.col("v").isNotNull() & ((name.isin(*typed) if typed else F.lit(False))
                                   | is_non_empty(F.col("v")))
    aggs = [F.sum(F.when(ne, 1).otherwise(0)).cast("bigint").alias("total")]
    for r in rs:
        blocked = [c for c, k in capable.items() if k is not None and r[1] not in k]
        if blocked and len(blocked) == len(capable):
            aggs.append(F.lit(0).cast("bigint").alias(f"hits_{r[0]}"))
            continue
        guard = ~name.isin(*blocked) if blocked else F.lit(True)
        if r[1] in needs:
            guard = guard & needs[r[1]]
        hit = ne & guard & F.col("v").rlike(unicode_pattern(r[3], unicode))
        aggs.append(F.sum(F.when(hit, 1).otherwise(0)).cast("bigint").alias(f"hits_{r[0]}"))
    return cells.groupBy("column").agg(*aggs)


def first_value_type(stats: DataFrame, rules=None,
                     threshold: float = FX.MATCH_THRESHOLD) -> Column:
    """The first rule (rank order) whose hit ratio reaches the threshold."""
    expr = None
    for r in _rules(rules):
        ok = (F.col("total") > 0) & (F.col(f"hits_{r[0]}") >= F.lit(threshold) * F.col("total"))
        expr = F.when(ok, F.lit(r[1])) if expr is None else expr.when(ok, F.lit(r[1]))
    return expr


def detect_values(df: DataFrame, columns: list[str] | None = None, rules=None,
                  key: str | None = None, sample_rows: int | None = None,
                  unicode: bool = False) -> DataFrame:
    """``(column, pii_type)`` for every atomic column (pii_type null if none)."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if is_atomic(f.dataType) and f.name != key]
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, pii_type string")
    if sample_rows is None:      # a sample is a top-n of keys: no row work to spread
        df = spread(df)      # no-op unless a small input sits in fewer files than task slots
    # one unpivot and one aggregation; typed columns evaluate fewer rules
    capable = {c: (None if (unicode or rules is not None) else capable_rules(df.schema[c].dataType))
               for c in columns}
    stats = value_stats(value_cells(df, columns, key, sample_rows), rules, unicode, capable)
    return stats.select("column", first_value_type(stats, rules).alias("pii_type"))


# ---------------------------------------------------------------------------
# Two passes (D6) and type helpers
# ---------------------------------------------------------------------------

def detect(df: DataFrame, rules=None, sample_rows: int | None = None, key: str | None = None,
           exclude: tuple[str, ...] | list[str] = (), unicode: bool = False) -> DataFrame:
    """Header pass, then the value pass for the columns it missed.

    Returns ``column, pii_type, method, default_tech, include`` for detected
    columns only, in table column order.  The header pass works on names
    alone; the value pass is one aggregation job over the data whose result
    (one row per column) is collected, so later steps (config, audit) never
    re-run the scan.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in exclude]
    header = {c: header_type(c, rules) for c in names}   # names only: bounded by width
    missed = [c for c in names if header[c] is None and is_atomic(df.schema[c].dataType)
              and c != key]
    by_value = {}
    if missed:
        for r in detect_values(df, missed, rules, key, sample_rows, unicode).collect():
            if r["pii_type"] is not None:
                by_value[r["column"]] = r["pii_type"]
    defaults = {r[1]: r[4] for r in _rules(rules)}
    rows = []
    for c in names:
        t, method = (header[c], "header") if header[c] is not None else (by_value.get(c), "value")
        if t is not None:
            rows.append((c, t, method, defaults.get(t, FX.FALLBACK_TECHNIQUE), True))
    return spark.createDataFrame(
        rows, "column string, pii_type string, method string, default_tech string, include boolean")


def type_summary(detected: DataFrame) -> DataFrame:
    """Every known type in order of its name, with its default technique and the number of columns detected as it."""
    known = detected.sparkSession.createDataFrame([(t, FX.default_technique(t)) for t in FX.pii_type_names()], "pii_type string, default_tech string")
    found = detected.groupBy("pii_type").agg(F.count(F.lit(1)).alias("columns"))
    # ten known types on the left, at most ten groups on the right
    return known.join(F.broadcast(found), "pii_type", "left").select("pii_type", "default_tech", F.coalesce("columns", F.lit(0)).alias("columns")).orderBy("pii_type")


# ---------------------------------------------------------------------------
# Spans inside long text
# ---------------------------------------------------------------------------

def span_counts(df: DataFrame, text: str, by: list[str], rules=None,
                unicode: bool = False) -> DataFrame:
    """Per group and type: rows with at least one span and the number of spans.

    Aggregated wide (one pair of sums per rule) so partial aggregation keeps
    the shuffle at one row per group per task, then unpivoted."""
    rs = _rules(rules)
    df = spread(df)
    needs = {}
    if rules is None and not unicode:
        # cheap per-row prerequisites (see NEEDS_DIGIT), computed once
        df = df.withColumn("__d", col(text).rlike("[0-9]")) \
            .withColumn("__at", F.instr(col(text), "@") > 0)
        needs = {t: F.col("__d") for t in NEEDS_DIGIT}
        needs[FX.EMAIL] = F.col("__at")
    aggs = []
    for r in rs:
        n = F.regexp_count(col(text), F.lit(unicode_pattern(r[3], unicode)))
        if r[1] in needs:
            n = F.when(needs[r[1]], n).otherwise(F.lit(0))
        aggs += [F.sum(F.when(n > 0, 1).otherwise(0)).cast("bigint").alias(f"r{r[0]}"),
                 F.sum(n).cast("bigint").alias(f"s{r[0]}")]
    wide = df.where(col(text).isNotNull()).groupBy(*[col(b) for b in by]).agg(*aggs)
    stack = ", ".join(f"{sql_string(r[1])}, r{r[0]}, s{r[0]}" for r in rs)
    return wide.select(*[col(b) for b in by], F.expr(f"stack({len(rs)}, {stack}) AS (pii_type, rows_with_hit, spans)"))


def redact_spans(text: Column, rules=None, unicode: bool = False,
                 marker: str = FX.REDACTED) -> Column:
    """Each span replaced by the marker, rules applied in rank order.

    Replacements only remove text or insert the marker (no digits), so a
    text without an ASCII digit never gains one: for such rows the
    digit-requiring built-in rules are skipped (same result)."""
    rs = _rules(rules)

    def chain(v: Column, skip_digit_rules: bool) -> Column:
        for r in rs:
            if skip_digit_rules and r[1] in NEEDS_DIGIT:
                continue
            v = F.regexp_replace(v, unicode_pattern(r[3], unicode), marker)
        return v

    if rules is not None or unicode or any(ch.isdigit() for ch in marker):
        return chain(text, False)
    return F.when(text.rlike("[0-9]"), chain(text, False)).otherwise(chain(text, True))
