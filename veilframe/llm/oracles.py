"""DuckDB SQL of the operators that SQL can express, written from their contracts."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TEXT = "coalesce(text, '')"
_LOWER = f"translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Two-word sets; candidates share one of each other's rarest shingles, as any pair at 0.8 must; links are counted on full sets.
NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
f AS (SELECT s, count(*) AS c FROM sh GROUP BY 1),
r AS (SELECT sh.doc_id, sh.s, n.n, row_number() OVER (PARTITION BY sh.doc_id ORDER BY f.c, sh.s) AS k FROM sh JOIN f USING (s) JOIN n USING (doc_id)),
p AS (SELECT doc_id, s, n FROM r WHERE k <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
com AS (SELECT a, b, count(*) AS c FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY a, b),
link AS (SELECT a, b FROM com JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(_TEXT)} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range(20) t(k)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY word.doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_TRIM = "trim(x, ' ')"
_N = f"greatest(length({_TRIM}) - length(replace({_TRIM}, ' ', '')) + 1, 1)"
_GOOD = rf"""regexp_matches(x, '[.!?:;,…。！？"''”’»)\]][\x20\x09-\x0D]*\z') AND NOT length(x) - length(replace(x, '!', '')) > 1 + {_N} / 2
    AND NOT (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 10 > {_N} * 2
    AND NOT regexp_matches(lower(x), 'licensed under|released under|all rights reserved|copyright|cookie|privacy policy|terms of use|terms of service|subscribe|click here|read more|skip to content')"""
_BARE = r"regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g')"

LINE_RULES = rf"""
WITH w AS (SELECT doc_id, {_TEXT} AS t, {_WORDS.format(_TEXT)} AS ws, list_filter(string_split({_TEXT}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8))) AS n FROM twice GROUP BY 1),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length({_BARE.format('t')}) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, length({_BARE.format("array_to_string(list_filter(lines, lambda x: " + _GOOD + "), '')")}) AS rest
    FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (word_chars - rest) <= 50 * word_chars AS kept FROM v
"""


_FIELDS = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in [*_FIELDS, text]) + ")"


def _level(k: int, keys: str, join: str) -> str:
    """Nodes of level k + 1 from those of level k, and each leaf's way one level up; ``keys``: the columns that name a tree."""
    return f"""
run{k} AS (SELECT {keys} i // 8 AS p, list(h ORDER BY i) AS hs, max(n) AS n FROM node{k} GROUP BY {keys} i // 8),
node{k + 1} AS (SELECT {keys} p AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 7) // 8 AS n FROM run{k}),
way{k + 1} AS (SELECT w.* EXCLUDE (pos, h, proof), CASE WHEN r.n = 1 THEN w.pos ELSE w.pos // 8 END AS pos,
    CASE WHEN r.n = 1 THEN w.h ELSE sha256(array_to_string(list_concat(hs[1:w.pos % 8], [w.h], hs[w.pos % 8 + 2:]), '')) END AS h,
    CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string(list_concat(hs[1:w.pos % 8], hs[w.pos % 8 + 2:]), '') END AS proof
    FROM way{k} w JOIN run{k} r ON r.p = w.pos // 8 {join}),"""


_HEIGHT = 8   # levels of a language's tree written out here: up to 8**8 rows of a language, and 8**8 languages
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""

#: Nodes level by level; beside them each leaf's way up, which gathers its siblings and folds the tampered leaf's digest with them.
MERKLE = f"""
WITH leaf AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("text")} AS leaf, {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
    {_CRC32} % 3 = 0 AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
node0 AS (SELECT tree, pos AS i, leaf AS h, n FROM placed),
way0 AS (SELECT doc_id, tree, leaf, pos, CASE WHEN tampered THEN other ELSE leaf END AS h, '' AS proof FROM placed),
{"".join(_level(k, "tree,", "AND r.tree = w.tree") for k in range(_HEIGHT))}
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM node{_HEIGHT}),
node{_HEIGHT + 1} AS (SELECT i, subroot AS h, n FROM sub),
way{_HEIGHT + 1} AS (SELECT w.* EXCLUDE (pos), sub.subroot, sub.i AS pos FROM way{_HEIGHT} w JOIN sub USING (tree)),
{"".join(_level(k, "", "") for k in range(_HEIGHT + 1, 2 * _HEIGHT + 1))}
top AS (SELECT h AS root FROM node{2 * _HEIGHT + 1})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM way{2 * _HEIGHT + 1}, top
"""
