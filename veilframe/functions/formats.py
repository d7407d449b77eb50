"""K2: fakes in the format of their own type, made from a dense index.

A format is a run of parts, each with a radix; an index below the product of the radices (the format's domain) names one text.
The index is first permuted over the domain by keyed Feistel rounds, so that neighbouring indexes give unlike fakes.  A domain is the
product of two halves ``a * b``; each round adds a hash of one half to the other one modulo its size.  That is a bijection of the domain
itself, so no index ever falls outside it and two indexes never share a fake.

Beyond the domain (more values of a type than its format has texts) a fake is the format's text with a tail ``~1``, ``~2``, ...: still
one fake a value, but out of format; ``operators.value_key.domain_use`` counts them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX
from veilframe.functions.fakes import (DEFAULT_LOCALE, FAKE_CARD_PREFIX, FAKE_DOB_SPAN_DAYS, FAKE_DOB_START, FAKE_EMAIL_DOMAIN, FAKE_ID_PREFIX, LOCALES, SEED)

ROUNDS = 8
TAIL = "~"
SYLLABLES = [c + v for c in "bcdfghjklmnprstvwxyz" for v in "aeiou"]
LETTERS = [chr(c) for c in range(ord("A"), ord("Z") + 1)]
#: Private IPv4 blocks: (first address as a number, size).
PRIVATE_BLOCKS = [(10 << 24, 1 << 24), ((172 << 24) + (16 << 16), 1 << 20), ((192 << 24) + (168 << 16), 1 << 16)]


@dataclass(frozen=True)
class Pick:
    """One of a pool of texts."""
    pool: tuple[str, ...]

    @property
    def radix(self) -> int:
        return len(self.pool)


@dataclass(frozen=True)
class Number:
    """A number from ``low`` on, zero-padded to ``width``."""
    radix: int
    width: int = 0
    low: int = 0


@dataclass(frozen=True)
class Day:
    """A date in a span of days."""
    start: str
    radix: int


@dataclass(frozen=True)
class Address4:
    """A private IPv4 address."""
    radix: int = sum(size for _, size in PRIVATE_BLOCKS)


@dataclass(frozen=True)
class Format:
    """Parts (a str is itself); ``halves`` multiply to the domain; ``luhn`` appends a card's check digit."""
    parts: tuple
    halves: tuple[int, int]
    luhn: bool = False

    @property
    def domain(self) -> int:
        return prod(p.radix for p in self.parts if not isinstance(p, str))


def _pick(pool: list[str]) -> Pick:
    return Pick(tuple(pool))


def format_of(pii_type: str | None, locale: str = DEFAULT_LOCALE) -> Format:
    """The format of a type's fakes; types without one of their own get a code ``AB12-CD34``."""
    if locale not in LOCALES:
        raise ValueError(f"unknown locale {locale!r}; known: {sorted(LOCALES)}")
    pools = LOCALES[locale]
    first, last = pools["first"], pools["last"]
    if pii_type == FX.FULL_NAME:
        caps = [s.capitalize() for s in SYLLABLES]
        return Format((_pick(first), " ", _pick(caps), _pick(SYLLABLES), _pick(SYLLABLES), " ", _pick(last)), (len(first) * 1000, 1000 * len(last)))
    if pii_type == FX.EMAIL:
        lower = [[x.lower() for x in p] for p in (first, last)]
        return Format((_pick(lower[0]), ".", _pick(lower[1]), Number(10 ** 6, 6), "@" + FAKE_EMAIL_DOMAIN), (len(first) * 1000, len(last) * 1000))
    if pii_type == FX.PHONE and locale == "de_DE":
        return Format(("+49-", Number(30, 3, 150), "-", Number(1000, 3), "-", Number(10 ** 7, 7)), (300_000, 1_000_000))
    if pii_type == FX.PHONE:
        return Format(("+1-", Number(800, 3, 200), "-", Number(800, 3, 200), "-", Number(10 ** 4, 4)), (80_000, 80_000))
    if pii_type == FX.ADDRESS:
        street, city = pools["street"], pools["city"]
        return Format((Number(9999, 0, 1), " ", _pick(street), ", ", _pick(city), " ", Number(10 ** 5, 5)), (9999 * len(street) * len(city), 10 ** 5))
    if pii_type == FX.DOB:
        return Format((Day(FAKE_DOB_START, FAKE_DOB_SPAN_DAYS),), (FAKE_DOB_SPAN_DAYS // 200, 200))
    if pii_type == FX.CREDIT_CARD:
        return Format((FAKE_CARD_PREFIX, Number(10 ** 11, 11)), (10 ** 5, 10 ** 6), luhn=True)
    if pii_type == FX.STUDENT_ID:
        return Format((FAKE_ID_PREFIX, Number(10 ** 6, 6)), (1000, 1000))
    if pii_type == FX.CNIC:
        return Format((Number(10 ** 5, 5), "-", Number(10 ** 7, 7), "-", Number(10, 1)), (10 ** 6, 10 ** 7))
    if pii_type == FX.IP_ADDRESS:
        return Format((Address4(),), (1 << 16, Address4().radix >> 16))
    letter = _pick(LETTERS)
    return Format((letter, letter, Number(100, 2), "-", letter, letter, Number(100, 2)), (26 * 26 * 100, 26 * 26 * 100))


def _part(p, x: Column) -> Column:
    """A part's text from its digit."""
    if isinstance(p, Pick):
        return F.element_at(F.array(*[F.lit(t) for t in p.pool]), (x + 1).cast("int"))
    if isinstance(p, Number):
        return F.format_string(f"%0{p.width}d" if p.width else "%d", x + p.low)
    if isinstance(p, Day):
        return F.date_format(F.date_add(F.lit(p.start).cast("date"), x.cast("int")), "yyyy-MM-dd")
    at, address = 0, None
    for low, size in PRIVATE_BLOCKS:
        own = x - at + low
        address = own if address is None else F.when(x >= at, own).otherwise(address)
        at += size
    return F.concat_ws(".", *[F.shiftright(address, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)])


def _luhn(digits: Column, n: int) -> Column:
    """The check digit behind ``n`` digits: every second one from the right is doubled, and 9 taken off above 9."""
    total = F.lit(0)
    for k in range(1, n + 1):
        d = F.substring(digits, k, 1).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if (n - k) % 2 == 0 else d)
    return F.pmod(-total, F.lit(10)).cast("string")


def render(fmt: Format, x: Column) -> Column:
    """The text of a (permuted) index below the domain."""
    below, texts = fmt.domain, []
    for p in fmt.parts:
        if isinstance(p, str):
            texts.append(F.lit(p))
        else:
            below //= p.radix
            texts.append(_part(p, F.pmod(F.floor(x / F.lit(below)).cast("bigint"), F.lit(p.radix).cast("bigint"))))   # exact: below 2**53
    text = F.concat(*texts)
    width = sum(len(p) if isinstance(p, str) else p.width for p in fmt.parts) if fmt.luhn else 0
    return F.concat(text, _luhn(text, width)) if fmt.luhn else text


def permuted(x: Column, a: Column, b: Column, key: Column) -> Column:
    """A keyed permutation of 0 .. a * b - 1: alternating Feistel rounds over (x div b, x mod b)."""
    def step(s: Column, k: Column) -> Column:
        def mixed(own: Column, other: Column, size: Column) -> Column:
            text = F.concat(key, F.lit("|"), k.cast("string"), F.lit("|"), other.cast("string"))
            return F.pmod(own + F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint"), size)

        left = F.when(k % 2 == 0, mixed(s["l"], s["r"], a)).otherwise(s["l"])
        right = F.when(k % 2 == 1, mixed(s["r"], s["l"], b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def fakes_of(types: list[str | None], which: Column, index: Column, locale: str = DEFAULT_LOCALE, seed: Column | str = SEED) -> Column:
    """The fake of each row's ``index`` (from 0) in its type ``types[which]``."""
    formats = [format_of(t, locale) for t in types]
    per_type = lambda values: F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), which + 1)
    domain = per_type([f.domain for f in formats])
    seed = F.lit(seed) if isinstance(seed, str) else seed
    key = F.concat(seed, F.element_at(F.array(*[F.lit(t or "") for t in types]), which + 1))
    inside = permuted(F.pmod(index, domain), per_type([f.halves[0] for f in formats]), per_type([f.halves[1] for f in formats]), key)
    # the permuted index is used by every type's text: worked out once, as the only element of an array
    def text(x: Column) -> Column:
        out = None
        for k, f in enumerate(formats):
            out = F.when(which == k, render(f, x)) if out is None else out.when(which == k, render(f, x))
        return out

    own = F.element_at(F.transform(F.array(inside), text), 1)
    laps = F.floor(index / domain)
    return F.when(laps > 0, F.concat(own, F.lit(TAIL), laps.cast("string"))).otherwise(own)
