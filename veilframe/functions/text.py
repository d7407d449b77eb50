"""Cell-level helpers shared by every technique: text view, blank rule, strip.

A cell is *blank* when it is null (NaN included for floating columns) or its
text is whitespace only.  "Whitespace" follows Python's ``str.strip``: the
ASCII set plus the Unicode separators below, so ``strip`` here is a regex
and not Spark's ``trim`` (which removes spaces only).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.fixed import NOT_EMPTY_EXCLUDED

# --- fixed values: characters Python's str.strip() removes --------------------
# \s (space, \t, \n, \f, \r), \x0b, \x1c-\x1f, \x85, \xa0,  ,  - ,
#  ,  ,  ,  , 　.  Written with \x{..} so the same
# pattern text is valid for Java regex and for RE2 (the DuckDB oracle).
WS = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

_FLOATING = (T.FloatType, T.DoubleType)


def _float_text(c: Column) -> Column:
    """A float as Python's ``str`` prints it: plain from 1e-4 up to 1e16, else
    ``1e+16`` / ``1.5e-05``.  Spark switches to ``1.0E7`` at 1e7 and below 1e-3,
    so the digits of that notation are moved to their place."""
    t = c.cast("string")
    sign = F.when(t.startswith("-"), "-").otherwise("")
    head = F.regexp_replace(F.substring_index(t, "E", 1), "^-", "")
    power = F.substring_index(t, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(head, r"\.0$", ""), r"\.", "")
    whole = F.rpad(digits, power + 1, "0")                  # rpad also cuts: the digits before the point
    rest = F.substr(digits, power + 2)
    large = F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    far = F.concat(sign, F.regexp_replace(head, r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"),
                   F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    moved = F.when((power >= 7) & (power < 16), large).when(power == -4, small).otherwise(far)
    return F.when(F.contains(t, F.lit("E")), moved).when(t == "Infinity", "inf").when(t == "-Infinity", "-inf").otherwise(t)


def as_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """The cell as text (``str(v)``); NaN in floating columns becomes null."""
    if dtype is None or isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, _FLOATING):
        size = F.abs(c)
        alike = ((size >= 1e-3) & (size < 1e7)) | (size == 0)       # Spark and Python print these alike; NaN compares as the largest number
        # as a function over an array of one: evaluated for the other numbers only, and it leaves the compiled stage small enough for the JIT
        rest = F.get(F.transform(F.array(c), _float_text), 0)
        return F.when(alike, c.cast("string")).when(~F.isnan(c), rest)
    return c.cast("string")


# the same characters as one string, for btrim (no regex per cell)
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
            + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(text: Column) -> Column:
    """Python ``str.strip()`` (all whitespace, both ends)."""
    return F.btrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    """Blank rule: null, or only whitespace.  ``text`` is already a string."""
    return text.isNull() | (py_strip(text) == F.lit(""))


def is_non_empty(text: Column) -> Column:
    """Counts toward the value-pass denominator:
    ``strip(v) not in ('', 'nan', 'NaN', 'None')``."""
    return text.isNotNull() & ~py_strip(text).isin(*NOT_EMPTY_EXCLUDED)


def unicode_pattern(pattern: str, unicode: bool) -> str:
    """``(?U)`` gives Java's \\d, \\s, \\w and \\b Python-like Unicode classes."""
    return "(?U)" + pattern if unicode else pattern


def sql_string(s: str) -> str:
    """A SQL string literal for ``F.expr`` text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_ident(name: str) -> str:
    """A back-quoted identifier for ``F.expr`` text."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name (dots and spaces are part of the name)."""
    return F.col(sql_ident(name))
