"""The six techniques as native Column expressions.

Each function takes the cell *text* (``as_text``) and returns a string
Column.  Every technique starts from the blank rule: blank cells come out
unchanged.  Nothing here is a Python UDF, so a configured projection stays
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import fixed as FX
from veilframe.functions.text import as_text, is_blank, py_strip, unicode_pattern, WS


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)).cast("int"))


def _digits(v: Column, unicode: bool = False) -> Column:
    return F.regexp_replace(v, unicode_pattern(r"\D", unicode), "")


# ---------------------------------------------------------------------------
# Masking
# ---------------------------------------------------------------------------

def mask_email(v: Column) -> Column:
    """First char of the local part, stars, then '@' and the domain (first '@')."""
    local = F.substring_index(v, "@", 1)
    domain = F.substr(v, F.instr(v, "@") + 1)
    return F.concat(F.left(local, F.lit(1)), _stars(F.length(local) - 1), F.lit("@"), domain)


def mask_phone(v: Column, unicode: bool = False) -> Column:
    """Digits only; >= 6 digits keep first 3 and last 3, else all stars."""
    d = _digits(v, unicode)
    n = F.length(d)
    return F.when(n >= 6, F.concat(F.left(d, F.lit(3)), _stars(n - 6), F.right(d, F.lit(3)))) \
        .otherwise(_stars(F.length(v)))


def mask_card(v: Column, unicode: bool = False) -> Column:
    """Digits only; stars then the last four digits."""
    d = _digits(v, unicode)
    return F.concat(_stars(F.length(d) - 4), F.right(d, F.lit(4)))


def mask_generic(v: Column) -> Column:
    """Up to 3 chars all stars; else first, stars, last."""
    n = F.length(v)
    return F.when(n <= 3, _stars(n)) \
        .otherwise(F.concat(F.left(v, F.lit(1)), _stars(n - 2), F.right(v, F.lit(1))))


def mask(v: Column, pii_type: str | None, unicode: bool = False) -> Column:
    if pii_type == FX.EMAIL:
        body = F.when(v.contains("@"), mask_email(v)).otherwise(mask_generic(v))
    elif pii_type == FX.PHONE:
        body = mask_phone(v, unicode)
    elif pii_type == FX.CREDIT_CARD:
        body = mask_card(v, unicode)
    else:
        body = mask_generic(v)
    return F.when(is_blank(v), v).otherwise(body)


# ---------------------------------------------------------------------------
# Hashing
# ---------------------------------------------------------------------------

def hash_sha256(v: Column, salt: Column | str | None = None) -> Column:
    """P5: lower-case hex SHA-256 of the UTF-8 text; no strip.  ``salt`` is X1."""
    payload = v if salt is None else F.concat(F.lit(salt) if isinstance(salt, str) else salt, v)
    return F.when(is_blank(v), v).otherwise(F.sha2(payload, 256))


# ---------------------------------------------------------------------------
# Generalization
# ---------------------------------------------------------------------------

# Text Python's float() accepts and int() can truncate (no inf / nan / '_').
_NUMBER = (r"\A" + WS + r"*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)" + WS + r"*\z")


def age_band(v: Column, unicode: bool = False) -> Column:
    """Truncate to an integer, floor to the decade: '-5' -> '-10--1'.

    Text that does not parse (or overflows a bigint) is returned unchanged.
    """
    num = F.regexp_extract(v, unicode_pattern(_NUMBER, unicode), 1)
    whole = F.when(num != "", num.try_cast("double")).try_cast("bigint")
    def between(n: Column) -> Column:
        lower = n - F.pmod(n, F.lit(10))
        return F.concat(lower.cast("string"), F.lit("-"), (lower + 9).cast("string"))

    # the first and last bands reach beyond a bigint
    band = F.when(F.abs(whole.cast("double")) < 9e18, between(whole)).otherwise(between(whole.cast("decimal(20,0)")))
    return F.when(whole.isNull(), v).otherwise(band)


def dob_year(v: Column) -> Column:
    """First 19xx/20xx year as a whole word, else unchanged."""
    year = F.regexp_extract(v, FX.DOB_YEAR_PATTERN, 0)
    return F.when(year == "", v).otherwise(year)


def ip_prefix(v: Column) -> Column:
    """Exactly four dot-separated parts -> 'a.b.x.x', else unchanged."""
    parts = F.split(v, r"\.", -1)
    return F.when(F.size(parts) == 4,
                  F.concat(parts.getItem(0), F.lit("."), parts.getItem(1), F.lit(".x.x"))) \
        .otherwise(v)


def address_tail(v: Column) -> Column:
    """Last comma-separated part (stripped) when there are two or more."""
    parts = F.split(v, ",", -1)
    return F.when(F.size(parts) >= 2, py_strip(F.element_at(parts, -1))) \
        .otherwise(F.lit(FX.LOCATION_GENERALIZED))


def generalize(v: Column, pii_type: str | None, unicode: bool = False) -> Column:
    if pii_type == FX.AGE:
        # Age checks null only; blank text fails to parse and comes back as is.
        return F.when(v.isNull(), v).otherwise(age_band(v, unicode))
    if pii_type == FX.DOB:
        body = dob_year(v)
    elif pii_type == FX.IP_ADDRESS:
        body = ip_prefix(v)
    elif pii_type == FX.ADDRESS:
        body = address_tail(v)
    else:
        body = F.lit(FX.GENERALIZED)                       # P10
    return F.when(is_blank(v), v).otherwise(body)


# ---------------------------------------------------------------------------
# Deletion / redaction
# ---------------------------------------------------------------------------

def delete(v: Column) -> Column:
    """Non-blank -> '' (empty string, not null)."""
    return F.when(is_blank(v), v).otherwise(F.lit(""))


def redact(v: Column) -> Column:
    """Non-blank -> '[REDACTED]'."""
    return F.when(is_blank(v), v).otherwise(F.lit(FX.REDACTED))


# ---------------------------------------------------------------------------
# Dispatch
# ---------------------------------------------------------------------------

def technique_column(c: Column, technique: str, pii_type: str | None,
                     dtype: T.DataType | None = None, unicode: bool = False,
                     salt: Column | str | None = None) -> Column | None:
    """The transformed column, or None when the technique needs the mapping
    (Fake Data) or is unknown (the caller keeps the column unchanged)."""
    v = as_text(c, dtype)
    if technique == FX.MASKING:
        return mask(v, pii_type, unicode)
    if technique == FX.HASHING:
        return hash_sha256(v, salt)
    if technique == FX.GENERALIZATION:
        return generalize(v, pii_type, unicode)
    if technique == FX.NULL_DELETION:
        return delete(v)
    if technique == FX.REDACTION:
        return redact(v)
    return None

