"""DuckDB SQL twins of the techniques, used only to write the oracle queries.

These are independent SQL formulations of the same rules, run by DuckDB on
the same parquet files; they are never used by the Spark code path.
"""

from __future__ import annotations

from veilframe.functions import fixed as FX
from veilframe.functions import fakes as FK
from veilframe.functions import formats as FM


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def blank(v: str) -> str:
    return f"({v} IS NULL OR regexp_full_match({v}, '\\s*'))"


def strip(v: str) -> str:
    return f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"


def mask_generic(v: str) -> str:
    return (f"CASE WHEN length({v}) <= 3 THEN repeat('*', length({v})) "
            f"ELSE left({v}, 1) || repeat('*', length({v}) - 2) || right({v}, 1) END")


def mask_email(v: str) -> str:
    local = f"substr({v}, 1, instr({v}, '@') - 1)"
    return (f"CASE WHEN instr({v}, '@') > 0 THEN left({local}, 1) || "
            f"repeat('*', greatest(length({local}) - 1, 0)) || '@' || substr({v}, instr({v}, '@') + 1) "
            f"ELSE {mask_generic(v)} END")


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '\\D', '', 'g')"


def mask_phone(v: str) -> str:
    d = _digits(v)
    return (f"CASE WHEN length({d}) >= 6 THEN left({d}, 3) || repeat('*', length({d}) - 6) || right({d}, 3) "
            f"ELSE repeat('*', length({v})) END")


def mask_card(v: str) -> str:
    d = _digits(v)
    return f"repeat('*', greatest(length({d}) - 4, 0)) || right({d}, 4)"


def age_band_int(v: str) -> str:
    """Band of an integer column (no parsing needed)."""
    lower = f"({v} - (({v} % 10) + 10) % 10)"
    return f"CAST({lower} AS VARCHAR) || '-' || CAST({lower} + 9 AS VARCHAR)"


def dob_year(v: str) -> str:
    y = f"regexp_extract({v}, {q(FX.DOB_YEAR_PATTERN)}, 0)"
    return f"CASE WHEN {y} = '' THEN {v} ELSE {y} END"


def ip_prefix(v: str) -> str:
    return (f"CASE WHEN len(string_split({v}, '.')) = 4 THEN split_part({v}, '.', 1) || '.' || "
            f"split_part({v}, '.', 2) || '.x.x' ELSE {v} END")


def address_tail(v: str) -> str:
    last = f"string_split({v}, ',')[-1]"
    return (f"CASE WHEN len(string_split({v}, ',')) >= 2 THEN {strip(last)} "
            f"ELSE {q(FX.LOCATION_GENERALIZED)} END")


def technique(v: str, tech: str, pii_type: str | None, numeric: bool = False) -> str:
    """SQL of one technique over a VARCHAR expression ``v`` (blank rule included)."""
    if tech == FX.MASKING:
        body = {FX.EMAIL: mask_email(v), FX.PHONE: mask_phone(v),
                FX.CREDIT_CARD: mask_card(v)}.get(pii_type, mask_generic(v))
    elif tech == FX.HASHING:
        body = f"sha256({v})"
    elif tech == FX.GENERALIZATION:
        if pii_type == FX.AGE and numeric:
            return f"CASE WHEN {v} IS NULL THEN NULL ELSE {age_band_int(v)} END"
        body = {FX.DOB: dob_year(v), FX.IP_ADDRESS: ip_prefix(v),
                FX.ADDRESS: address_tail(v)}.get(pii_type, q(FX.GENERALIZED))
    elif tech == FX.NULL_DELETION:
        body = "''"
    elif tech == FX.REDACTION:
        body = q(FX.REDACTED)
    else:
        return v
    return f"CASE WHEN {blank(v)} THEN {v} ELSE {body} END"


# ---------------------------------------------------------------------------
# Fakes (K2) in SQL, for the pseudonym oracles
# ---------------------------------------------------------------------------

def _list(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _number(h: str, at: int, n: int) -> str:
    return f"CAST('0x' || substr({h}, {at}, {n}) AS BIGINT)"


def _pick(pool: list[str], h: str, at: int) -> str:
    return f"({_list(pool)})[{_number(h, at, 6)} % {len(pool)} + 1]"


def fake_value(pii_type: str | None, original: str, locale: str = FK.DEFAULT_LOCALE) -> str:
    """The fake of a VARCHAR expression, written from K2's formats."""
    p = FK.LOCALES[locale]
    h = f"sha256({q(FK.SEED)} || {original})"
    token = f"substr({h}, 33, 26)"
    letters = f"translate({token}, '0123456789abcdef', 'abcdefghijklmnop')"
    digits = f"printf('%016d', {_number(h, 33, 13)}) || printf('%016d', {_number(h, 46, 13)})"
    first, last = _pick(p["first"], h, 1), _pick(p["last"], h, 7)
    if pii_type == FX.FULL_NAME:
        return f"{first} || ' ' || {last} || ' ' || upper(left({letters}, 1)) || substr({letters}, 2)"
    if pii_type == FX.EMAIL:
        return f"lower({first}) || '.' || lower({last}) || '.' || {token} || '@{FK.FAKE_EMAIL_DOMAIN}'"
    if pii_type == FX.PHONE:
        return f"{q(p['phone'])} || {digits}"
    if pii_type == FX.ADDRESS:
        return (f"CAST({_number(h, 1, 6)} % 9999 + 1 AS VARCHAR) || ' ' || {_pick(p['street'], h, 7)} || ', Unit ' || upper({letters}) "
                f"|| ', ' || {_pick(p['city'], h, 13)}")
    if pii_type == FX.DOB:
        return (f"strftime(DATE {q(FK.FAKE_DOB_START)} + CAST({_number(h, 1, 6)} % {FK.FAKE_DOB_SPAN_DAYS} AS INTEGER), '%Y-%m-%d') "
                f"|| '#' || {token}")
    if pii_type == FX.CREDIT_CARD:
        return f"{q(FK.FAKE_CARD_PREFIX)} || {digits}"
    if pii_type == FX.STUDENT_ID:
        return f"{q(FK.FAKE_ID_PREFIX)} || {digits}"
    if pii_type == FX.CNIC:
        return f"substr({digits}, 1, 5) || '-' || substr({digits}, 6, 7) || '-' || substr({digits}, 13)"
    if pii_type == FX.IP_ADDRESS:
        return f"'fd' || substr({h}, 61, 2) || " + " || ".join(f"':' || substr({h}, {33 + 4 * k}, 4)" for k in range(7))
    two = [f"printf('%02d', {_number(h, at, 6)} % 100)" for at in (1, 7)]
    return f"upper(substr({letters}, 1, 2)) || {two[0]} || '-' || upper(substr({letters}, 3, 2)) || {two[1]} || '-' || upper({letters})"


# ---------------------------------------------------------------------------
# K1 / K2 by value: rank by hash, permuted over the format's domain
# ---------------------------------------------------------------------------

def _case(values: dict, of: str = "pii_type") -> str:
    return "CASE " + " ".join(f"WHEN {of} IS NOT DISTINCT FROM {q(t) if t else 'NULL'} THEN {v}" for t, v in values.items()) + " END"


def _format_text(fmt: FM.Format, x: str) -> str:
    below, texts = fmt.domain, []
    for p in fmt.parts:
        if isinstance(p, str):
            texts.append(q(p))
            continue
        below //= p.radix
        d = f"(({x} // {below}) % {p.radix})"
        if isinstance(p, FM.Pick):
            texts.append(f"({_list(list(p.pool))})[{d} + 1]")
        elif isinstance(p, FM.Number):
            texts.append(f"printf('%{f'0{p.width}' if p.width else ''}d', {d} + {p.low})")
        elif isinstance(p, FM.Day):
            texts.append(f"strftime(DATE {q(p.start)} + CAST({d} AS INTEGER), '%Y-%m-%d')")
        else:
            ten = f"'10.' || ({x} // 65536) || '.' || ({x} // 256 % 256) || '.' || ({x} % 256)"
            y, z = f"({x} - 16777216)", f"({x} - 17825792)"
            texts.append(f"CASE WHEN {x} < 16777216 THEN {ten} WHEN {x} < 17825792 THEN '172.' || (16 + {y} // 65536) || '.' || ({y} // 256 % 256) || '.' || ({y} % 256) "
                         f"ELSE '192.168.' || ({z} // 256) || '.' || ({z} % 256) END")
    text = " || ".join(f"({t})" for t in texts)
    if not fmt.luhn:
        return text
    total = (f"list_sum(list_transform(range(1, 16), lambda i: CASE WHEN (15 - i) % 2 = 1 THEN CAST(substr({text}, i, 1) AS INTEGER) "
             f"WHEN CAST(substr({text}, i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr({text}, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr({text}, i, 1) AS INTEGER) END))")
    return f"({text}) || CAST((10 - CAST({total} AS BIGINT) % 10) % 10 AS VARCHAR)"


def value_mapping(table_sql: str, columns: list[tuple[str, str | None]], locale: str = FK.DEFAULT_LOCALE) -> str:
    """``(original, fake, pii_type, n)``: the first column that holds a value decides its type."""
    cells = " UNION ALL ".join(f"SELECT {k} AS ord, {strip(c)} AS original FROM ({table_sql}) t WHERE NOT {blank(c)}" for k, (c, _t) in enumerate(columns))
    types = "CASE ord " + " ".join(f"WHEN {k} THEN {q(t) if t else 'NULL'}" for k, (_c, t) in enumerate(columns)) + " END"
    formats = {t: FM.format_of(t, locale) for t in dict.fromkeys(t for _c, t in columns)}
    state = (f"SELECT original, n, pii_type, idx // domain AS laps, (idx % domain) // b AS l, (idx % domain) % b AS r, a, b FROM (SELECT *, "
             f"{_case({t: f.domain for t, f in formats.items()})} AS domain, {_case({t: f.halves[0] for t, f in formats.items()})} AS a, "
             f"{_case({t: f.halves[1] for t, f in formats.items()})} AS b FROM (SELECT original, n, pii_type, "
             f"row_number() OVER (PARTITION BY pii_type ORDER BY sha256({q(FK.SEED)} || original)) - 1 AS idx FROM (SELECT original, n, {types} AS pii_type FROM "
             f"(SELECT original, min(ord) AS ord, count(*) AS n FROM ({cells}) c GROUP BY original) f) g) i) j")
    for k in range(FM.ROUNDS):
        own, other, size = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        number = f"CAST('0x' || substr(sha256({q(FK.SEED)} || coalesce(pii_type, '') || '|{k}|' || {other}), 1, 13) AS BIGINT)"
        state = f"SELECT * REPLACE (({own} + {number}) % {size} AS {own}) FROM ({state}) s{k}"
    text = _case({t: _format_text(f, "x") for t, f in formats.items()})
    return (f"SELECT original, {text} || CASE WHEN laps > 0 THEN '{FM.TAIL}' || laps ELSE '' END AS fake, pii_type, n "
            f"FROM (SELECT *, l * b + r AS x FROM ({state}) s) y")


def value_apply(table_sql: str, keep: list[str], columns: list[tuple[str, str | None]], locale: str = FK.DEFAULT_LOCALE) -> str:
    joins = " ".join(f"LEFT JOIN m m{k} ON NOT {blank(f'p.{c}')} AND m{k}.original = {strip(f'p.{c}')}" for k, (c, _t) in enumerate(columns))
    sel = [f"p.{c}" for c in keep] + [f"coalesce(m{k}.fake, p.{c}) AS {c}" for k, (c, _t) in enumerate(columns)]
    return f"WITH m AS ({value_mapping(table_sql, columns, locale)}) SELECT {', '.join(sel)} FROM ({table_sql}) p {joins}"


# ---------------------------------------------------------------------------
# Detection (D2-D8) in SQL
# ---------------------------------------------------------------------------

def keywords_values() -> str:
    rows = [f"({r[0]}, {q(r[1])}, {q(kw)})" for r in FX.PII_RULES for kw in r[2]]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") kw(rank, pii_type, keyword)"


def header_hits(cat: str, name_col: str, keys: list[str]) -> str:
    """``keys`` + pii_type for catalog rows with a keyword hit."""
    k = ", ".join(keys)
    return (f"SELECT {k}, arg_min(kw.pii_type, kw.rank) AS pii_type FROM ({cat}) c "
            f"JOIN ({keywords_values()}) kw ON contains(lower({strip(name_col)}), kw.keyword) "
            f"GROUP BY {k}")


def non_empty(v: str) -> str:
    return f"({v} IS NOT NULL AND {strip(v)} NOT IN ('', 'nan', 'NaN', 'None'))"


def value_types(table_sql: str, columns: list[str], key: str | None = None,
                sample_rows: int | None = None) -> str:
    """``(column, pii_type)`` per column via UNPIVOT + one aggregation."""
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
    sel = (f"{key}, " if key else "") + casts
    cells = (f"UNPIVOT (SELECT {sel} FROM ({table_sql}) t) ON {', '.join(columns)} "
             f"INTO NAME \"column\" VALUE v")
    if sample_rows is not None:
        cells = (f"SELECT \"column\", v FROM ({cells}) u "
                 f"QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY {key}) <= {sample_rows}")
    sums = [f"sum(CASE WHEN {non_empty('v')} THEN 1 ELSE 0 END) AS total"]
    for r in FX.PII_RULES:
        sums.append(f"sum(CASE WHEN {non_empty('v')} AND regexp_matches(v, {q(r[3])}) THEN 1 ELSE 0 END) "
                    f"AS hits_{r[0]}")
    stats = f"SELECT \"column\", {', '.join(sums)} FROM ({cells}) x GROUP BY \"column\""
    case = " ".join(f"WHEN total > 0 AND hits_{r[0]} >= {FX.MATCH_THRESHOLD} * total THEN {q(r[1])}"
                    for r in FX.PII_RULES)
    return f"SELECT \"column\", CASE {case} END AS pii_type FROM ({stats}) s"


def default_tech(t: str) -> str:
    whens = " ".join(f"WHEN {t} = {q(r[1])} THEN {q(r[4])}" for r in FX.PII_RULES)
    return f"CASE {whens} ELSE {q(FX.FALLBACK_TECHNIQUE)} END"


def detection(table_sql: str, columns: list[str], exclude: tuple = ()) -> str:
    """Detected columns ``column, pii_type, method, default_tech, include``."""
    cols = [c for c in columns if c not in exclude]
    names = "SELECT * FROM (VALUES " + ", ".join(f"({q(c)})" for c in cols) + ") n(\"column\")"
    hh = header_hits(names, '"column"', ['"column"'])
    vt = value_types(table_sql, cols)
    both = (f"SELECT n.\"column\", h.pii_type AS h_type, v.pii_type AS v_type FROM ({names}) n "
            f"LEFT JOIN ({hh}) h ON h.\"column\" = n.\"column\" "
            f"LEFT JOIN ({vt}) v ON v.\"column\" = n.\"column\"")
    return (f"SELECT \"column\", coalesce(h_type, v_type) AS pii_type, "
            f"CASE WHEN h_type IS NOT NULL THEN 'header' ELSE 'value' END AS method, "
            f"{default_tech('coalesce(h_type, v_type)')} AS default_tech, TRUE AS include "
            f"FROM ({both}) b WHERE coalesce(h_type, v_type) IS NOT NULL")


def profiles_values() -> str:
    rows = []
    for name, _tags, techs, prio in FX.PROFILES:
        for t, tech in techs.items():
            rows.append(f"({q(name)}, {q(t)}, {q(tech)}, {'TRUE' if t in prio else 'FALSE'})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) +
            ") p(profile, pii_type, technique, priority)")


# ---------------------------------------------------------------------------
# P16 in SQL: candidates of every rule, taken rank by rank
# ---------------------------------------------------------------------------

def taken_spans(table: str, key: str, text: str, types: list[str]) -> str:
    """CTEs that end in ``taken`` (key, rank, pii_type, first, last, value), positions in characters from 0."""
    parts, before = [f"texts AS (SELECT {key}, {text} AS v FROM {table})"], ""
    for r in FX.PII_RULES:
        if r[1] not in types:
            continue
        gaps, hits = f"string_split_regex(v, {q(r[3])})", f"regexp_extract_all(v, {q(r[3])}, 0)"
        found = (f"SELECT {key}, {r[0]} AS rank, {q(r[1])} AS pii_type, m[i] AS value, "
                 f"CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS first "
                 f"FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, {hits} AS m, {gaps} AS g FROM texts WHERE v IS NOT NULL) a) b")
        own = f"SELECT *, first + length(value) AS last FROM ({found}) f"
        if before:
            own = f"SELECT * FROM ({own}) c WHERE NOT EXISTS (SELECT 1 FROM {before} t WHERE t.{key} = c.{key} AND t.first < c.last AND c.first < t.last)"
            own = f"SELECT * FROM {before} UNION ALL ({own})"
        before = f"taken{r[0]}"
        parts.append(f"{before} AS MATERIALIZED ({own})")
    return "WITH " + ", ".join(parts) + f", taken AS (SELECT * FROM {before})"


def protected_text(table: str, key: str, text: str, config: dict[str, str]) -> str:
    done = "CASE " + " ".join(
        f"WHEN pii_type = {q(t)} THEN {fake_value(t, strip('value')) if tech == FX.FAKE_DATA else technique('value', tech, t)}" for t, tech in config.items()) + " END"
    return (f"{taken_spans(table, key, text, list(config))}, "
            f"piece AS (SELECT {key}, first, last, substr(v, gap + 1, first - gap) || {done} AS p FROM "
            f"(SELECT t.*, v, coalesce(lag(last) OVER (PARTITION BY {key} ORDER BY first), 0) AS gap FROM taken t JOIN texts USING ({key})) s), "
            f"whole AS (SELECT {key}, string_agg(p, '' ORDER BY first) AS p, max(last) AS last FROM piece GROUP BY {key}) "
            f"SELECT texts.{key}, CASE WHEN p IS NULL THEN v ELSE p || substr(v, last + 1) END AS {text} FROM texts LEFT JOIN whole USING ({key})")
