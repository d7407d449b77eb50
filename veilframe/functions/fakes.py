"""K2: fake values as pure functions of ``(type, original)``.

A fake is a shape of its type filled from ``sha2(seed || original)``: pools and
short fields for looks, and a token of 104 bits or more, so two originals of
a type share a fake only if two hashes agree in those bits.  The shapes of
different types never overlap, so fakes are distinct across types too (restore
joins on the fake alone).  Replacement is row-local: no index, join or
shuffle, and the same original gives the same fake in every table, run and
micro-batch of one seed and locale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX

# --- pools of invented people and places, by locale ---------------------------
LOCALES = {
    "en_US": {
        "first": ["James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael", "Linda",
                  "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph",
                  "Jessica", "Thomas", "Sarah", "Charles", "Karen"],
        "last": ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis",
                 "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez", "Wilson", "Anderson",
                 "Thomas", "Taylor", "Moore", "Jackson", "Martin"],
        "street": ["Oak Street", "Maple Avenue", "Cedar Lane", "Pine Road", "Elm Drive",
                   "Birch Court", "Walnut Way", "Willow Place", "Spruce Terrace", "Aspen Boulevard"],
        "city": ["Springfield", "Riverton", "Fairview", "Lakeside", "Greenville", "Madison",
                 "Clinton", "Franklin", "Georgetown", "Salem"],
        "phone": "+1-555-",
    },
    "de_DE": {
        "first": ["Anna", "Lukas", "Lena", "Jonas", "Marie", "Felix", "Clara", "Paul", "Greta", "Emil"],
        "last": ["Schneider", "Fischer", "Weber", "Wagner", "Becker", "Hoffmann", "Koch", "Richter",
                 "Wolf", "Neumann"],
        "street": ["Lindenweg", "Bergstrasse", "Gartenweg", "Schulstrasse", "Bahnhofplatz"],
        "city": ["Neustadt", "Altdorf", "Steinbach", "Waldheim", "Seefeld"],
        "phone": "+49-555-",
    },
}
DEFAULT_LOCALE = "en_US"
FAKE_EMAIL_DOMAIN = "example.net"
FAKE_CARD_PREFIX = "4000"
FAKE_ID_PREFIX = "ID-"
# Birth dates for ages 18 to 80 at FAKE_CLOCK, a year to spare at the young end.
FAKE_CLOCK = "2026-01-01"
FAKE_DOB_START = "1946-01-01"
FAKE_DOB_SPAN_DAYS = 22000
SEED = "42|"                        # hashed in front of each original


def fake_hash(original: Column, seed: Column | str = SEED) -> Column:
    return F.sha2(F.concat(F.lit(seed) if isinstance(seed, str) else seed, original), 256)


def _number(h: Column, at: int, n: int) -> Column:
    """``n`` hex digits of the hash as a bigint."""
    return F.conv(F.substring(h, at, n), 16, 10).cast("bigint")


def _pick(pool: list[str], h: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (_number(h, at, 6) % len(pool) + 1).cast("int"))


def _hex(h: Column) -> Column:
    """26 hex digits, 104 bits."""
    return F.substring(h, 33, 26)


def _letters(h: Column) -> Column:
    """The same 104 bits as letters a-p."""
    return F.translate(_hex(h), "0123456789abcdef", "abcdefghijklmnop")


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _digits(h: Column) -> Column:
    """104 bits as 32 decimal digits: two numbers of 13 hex digits."""
    return F.concat(_padded(_number(h, 33, 13), 16), _padded(_number(h, 46, 13), 16))


def fake_name(h: Column, pools: dict) -> Column:
    return F.concat(_pick(pools["first"], h, 1), F.lit(" "), _pick(pools["last"], h, 7), F.lit(" "), F.initcap(_letters(h)))


def fake_email(h: Column, pools: dict) -> Column:
    return F.concat(F.lower(_pick(pools["first"], h, 1)), F.lit("."), F.lower(_pick(pools["last"], h, 7)), F.lit("."),
                    _hex(h), F.lit("@" + FAKE_EMAIL_DOMAIN))


def fake_phone(h: Column, pools: dict) -> Column:
    return F.concat(F.lit(pools["phone"]), _digits(h))


def fake_address(h: Column, pools: dict) -> Column:
    return F.concat((_number(h, 1, 6) % 9999 + 1).cast("string"), F.lit(" "), _pick(pools["street"], h, 7),
                    F.lit(", Unit "), F.upper(_letters(h)), F.lit(", "), _pick(pools["city"], h, 13))


def fake_dob(h: Column, pools: dict) -> Column:
    day = F.date_add(F.lit(FAKE_DOB_START).cast("date"), (_number(h, 1, 6) % FAKE_DOB_SPAN_DAYS).cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("#"), _hex(h))


def fake_card(h: Column, pools: dict) -> Column:
    return F.concat(F.lit(FAKE_CARD_PREFIX), _digits(h))


def fake_id(h: Column, pools: dict) -> Column:
    return F.concat(F.lit(FAKE_ID_PREFIX), _digits(h))


def fake_cnic(h: Column, pools: dict) -> Column:
    d = _digits(h)
    return F.concat(F.substring(d, 1, 5), F.lit("-"), F.substring(d, 6, 7), F.lit("-"), F.substring(d, 13, 20))


def fake_ip(h: Column, pools: dict) -> Column:
    """A private address (IPv6 fd00::/8, 120 bits of the hash): the 24 bits of 10.0.0.0/8 are too few."""
    parts = [F.substring(h, 33 + 4 * k, 4) for k in range(7)]
    return F.concat(F.lit("fd"), F.substring(h, 61, 2), *[x for p in parts for x in (F.lit(":"), p)])


def fake_code(h: Column, pools: dict) -> Column:
    """Other types: two letters, two digits, '-', two letters, two digits, '-', letters."""
    t = F.upper(_letters(h))
    two = [_padded(_number(h, at, 6) % 100, 2) for at in (1, 7)]
    return F.concat(F.substring(t, 1, 2), two[0], F.lit("-"), F.substring(t, 3, 2), two[1], F.lit("-"), t)


_BY_TYPE = {
    FX.FULL_NAME: fake_name,
    FX.EMAIL: fake_email,
    FX.PHONE: fake_phone,
    FX.ADDRESS: fake_address,
    FX.DOB: fake_dob,
    FX.CREDIT_CARD: fake_card,
    FX.STUDENT_ID: fake_id,
    FX.CNIC: fake_cnic,
    FX.IP_ADDRESS: fake_ip,
}


def fake_value(pii_type: str | None, original: Column, locale: str = DEFAULT_LOCALE,
               seed: Column | str = SEED) -> Column:
    """The fake of a non-blank, stripped text."""
    if locale not in LOCALES:
        raise ValueError(f"unknown locale {locale!r}; known: {sorted(LOCALES)}")
    shape, pools = _BY_TYPE.get(pii_type, fake_code), LOCALES[locale]
    # as a function over an array of one: the shape uses the hash many times and it is worked out once, and the compiled stage stays
    # small enough for the JIT
    return F.get(F.transform(F.array(fake_hash(original, seed)), lambda h: shape(h, pools)), 0)
