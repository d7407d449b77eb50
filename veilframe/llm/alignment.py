"""Token alignment of two tokenizers by an associative monoid of fragments.

A (byte-level BPE) and B (BPE of pieces) cut the same bytes, a space and the text.  Where tokens of both end together, a group ends: its last
tokens are linked.  A fragment is what is known of a stretch of the bytes: an open prefix (tokens up to the first common end, whose
group may have begun earlier), closed groups, and an open suffix (tokens behind the last common end).  Two neighbouring fragments
compose to one: the left one's suffix and the right one's prefix are cut anew.  This is associative, so the fragments of a very long document are made
in different tasks and composed in a tree, ``FAN`` neighbours at a time.

A tokenizer's merges never reach across a white space that follows another character, so long texts are cut there; each tokenizer takes its own
cuts, as B knows spaces only, and so a fragment's tokens of A and of B need not cover the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm.base import Tables, map_texts

A_NAME, B_NAME = "byte_bpe_50k", "piece_bpe_32k"
CHUNK = 1 << 16        # characters of a chunk; it ends at the next place that is safe to cut
FAN = 8                # fragments composed by one row of a level of the tree
SENT = 1_000_000       # id pairs that are broadcast at most, with two numbers each
_CUT_A = re.compile(r"(?<!\s)[ \n\t]")
_CUT_B = re.compile(r"(?<! ) ")
#: Latin letters, digits and common punctuation: classes that do not differ between Unicode versions.
_PLAIN = re.compile("[^\x00-ſ‐-‧]")
_NONE = np.empty(0, np.int64)


class Side:
    """One tokenizer: ids of text segments, and its tokens' bytes."""

    def __init__(self, token_bytes: list[bytes], encode):
        self.bytes, self.encode = token_bytes, encode
        self.length = np.array([len(x) for x in token_bytes], np.int64)

    def ids(self, segments: list[str], data: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each segment; None where their bytes aren't the segment's."""
        out = []
        for found, raw in zip(self.encode(segments), data, strict=True):
            same = b"".join([self.bytes[k] for k in found]) == raw
            out.append(np.array(found, np.int64) if same else None)
        return out


@cache
def side_a(name: str = A_NAME) -> Side:
    """Ids by the tokenizer file; plain Latin text goes through the same vocabulary's faster encoder."""
    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    whole.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
    quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        table[k] = token

    def encode(segments: list[str]) -> list[list[int]]:
        return [whole.encode(x, add_special_tokens=False).ids if _PLAIN.search(x) else quick.encode_ordinary(x) for x in segments]

    return Side(table, encode)


@cache
def side_b(name: str = B_NAME) -> Side:
    """Ids of segments that begin with a space, which the model adds itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
    table = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        table.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(k) else b"" if model.is_control(k) else piece.replace("▁", " ").encode())

    def encode(segments: list[str]) -> list[list[int]]:
        # a segment of nothing but the space that the model adds: an empty text gives no token
        return [ids or [space] for ids in model.encode([x[1:] for x in segments], num_threads=1)]

    space = model.piece_to_id("▁")
    return Side(table, encode)


class Tokens(NamedTuple):
    """Tokens of both sides with the byte offsets at which they end."""
    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*[np.concatenate([x, y]) for x, y in zip(self, other, strict=True)])


NOTHING = Tokens(_NONE, _NONE, _NONE, _NONE)


class Fragment(NamedTuple):
    """A stretch of a document.  Without a common end (``cut``) all its tokens are in ``prefix``.

    ``groups`` is the closed groups as text, each followed by ";"; ``pairs`` and ``times`` count the links of the closed groups
    by (a id * 2**32 + b id).
    """
    cut: bool
    prefix: Tokens
    groups: str
    n_groups: int
    pairs: np.ndarray
    times: np.ndarray
    suffix: Tokens


@cache
def _printed(size: int, last: str) -> list[str]:
    """Token k as text in the middle of its group's side (place 2k) and at its end (2k + 1)."""
    return [text for k in range(size) for text in (f"{k},", f"{k}{last}")]


def _closed(t: Tokens, common: np.ndarray) -> tuple[str, int, np.ndarray, np.ndarray]:
    """Groups that end at the common ends, as text, their number and their links."""
    if not len(common):
        return "", 0, _NONE, _NONE
    group_a, group_b = np.searchsorted(common, t.a_ends), np.searchsorted(common, t.b_ends)
    last_a, last_b = common[group_a] == t.a_ends, common[group_b] == t.b_ends
    written = np.empty(len(t.a) + len(t.b), object)
    place_a = np.arange(len(t.a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(t.b)) + np.searchsorted(group_a, group_b, side="right")
    print_a, print_b = _printed(1 << 16, "|"), _printed(1 << 15, ";")
    written[place_a] = [print_a[k] for k in (2 * t.a + last_a).tolist()]
    written[place_b] = [print_b[k] for k in (2 * t.b + last_b).tolist()]
    pairs, times = np.unique((t.a[last_a] << 32) | t.b[last_b], return_counts=True)
    return "".join(written.tolist()), len(common), pairs, times


def fragment(t: Tokens) -> Fragment:
    """The fragment of a stretch's tokens."""
    common = np.intersect1d(t.a_ends, t.b_ends, assume_unique=True)
    if not len(common):
        return Fragment(False, t, "", 0, _NONE, _NONE, NOTHING)
    a0, b0 = np.searchsorted(t.a_ends, common[0]) + 1, np.searchsorted(t.b_ends, common[0]) + 1
    a1, b1 = np.searchsorted(t.a_ends, common[-1]) + 1, np.searchsorted(t.b_ends, common[-1]) + 1
    part = lambda a, b: Tokens(t.a[a], t.a_ends[a], t.b[b], t.b_ends[b])
    middle = part(slice(a0, a1), slice(b0, b1))
    return Fragment(True, part(slice(a0), slice(b0)), *_closed(middle, common[1:]), part(slice(a1, None), slice(b1, None)))


def _counted(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, which, np.concatenate(times))
    return found, total


def _whole(t: Tokens) -> tuple[str, int, np.ndarray, np.ndarray]:
    """A prefix that has turned out to be one group."""
    return _closed(t, t.a_ends[-1:])


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring stretches.  Associative."""
    middle = fragment((x.suffix if x.cut else x.prefix) + y.prefix)
    if not middle.cut:          # then y has no common end either
        return x._replace(suffix=middle.prefix) if x.cut else middle
    parts = []
    if x.cut:
        parts += [(x.groups, x.n_groups, x.pairs, x.times), _whole(middle.prefix)]
    parts.append((middle.groups, middle.n_groups, middle.pairs, middle.times))
    if y.cut:
        parts.append((y.groups, y.n_groups, y.pairs, y.times))
    groups, numbers, pairs, times = zip(*parts, strict=True)
    return Fragment(True, x.prefix if x.cut else middle.prefix, "".join(groups), sum(numbers), *_counted(pairs, times),
                    y.suffix if y.cut else middle.suffix)


def finished(f: Fragment) -> tuple[str, int, np.ndarray, np.ndarray]:
    """Groups of a whole document: its start closes the prefix's group, and its end is common to both sides."""
    if not f.cut:
        return "", 0, _NONE, _NONE
    first = _whole(f.prefix)
    return first[0] + f.groups, first[1] + f.n_groups, *_counted([first[2], f.pairs], [first[3], f.times])


def cuts(text: str, pattern: re.Pattern, chunk: int) -> list[int]:
    """Where the k-th chunk of a text starts, for all k: the first safe place from character k * chunk on, or the end."""
    out = [0]
    for at in range(chunk, len(text), chunk):
        found = pattern.search(text, max(at, out[-1]))
        out.append(found.start() if found else len(text))
    return [*out, len(text)]


def chunks(text: str, chunk: int = CHUNK) -> list[tuple[int, str, int, str]]:
    """(byte at which A's segment starts, A's segment, B's start, B's segment) of each chunk of a space and the text."""
    line = " " + text
    at_a, at_b = cuts(line, _CUT_A, chunk), cuts(line, _CUT_B, chunk)
    out, byte_a, byte_b = [], 0, 0
    for k in range(len(at_a) - 1):
        a, b = line[at_a[k]:at_a[k + 1]], line[at_b[k]:at_b[k + 1]]
        out.append((byte_a, a, byte_b, b))
        byte_a, byte_b = byte_a + len(a.encode()), byte_b + len(b.encode())
    return out


def _tokens(starts_a, segments_a, starts_b, segments_b) -> list[Tokens | None]:
    """Tokens of chunks; None where a side's bytes aren't the text's."""
    def ends(side: Side, starts, segments):
        # an empty segment has no tokens
        used = [k for k, x in enumerate(segments) if x]
        found: list = [_NONE] * len(segments)
        texts = [segments[k] for k in used]
        for k, ids in zip(used, side.ids(texts, [x.encode() for x in texts]), strict=True):
            found[k] = ids
        return [(x, None if x is None else s + np.cumsum(side.length[x])) for s, x in zip(starts, found, strict=True)]

    both = zip(ends(side_a(), starts_a, segments_a), ends(side_b(), starts_b, segments_b), strict=True)
    return [None if a is None or b is None else Tokens(a, a_ends, b, b_ends) for (a, a_ends), (b, b_ends) in both]


_TOKEN_FIELDS = [f"{part}_{name}" for part in ("prefix", "suffix") for name in Tokens._fields]
_STATE = "row long, seq long, ok boolean, n_a long, n_b long, cut boolean, groups string, n_groups long, pairs array<long>, times array<long>, " + ", ".join(
    f"{name} array<long>" for name in _TOKEN_FIELDS)
_DONE = "row long, n_a long, n_b long, n_groups long, pairs array<long>, times array<long>, groups_sha256 string"


def _to_row(row: int, seq: int, n_a: int, n_b: int, f: Fragment | None) -> tuple:
    """A fragment as a row of ``_STATE``; None is one whose bytes differ."""
    own = f or Fragment(False, NOTHING, "", 0, _NONE, _NONE, NOTHING)
    return (row, seq, f is not None, n_a, n_b, own.cut, own.groups, own.n_groups, own.pairs, own.times, *own.prefix, *own.suffix)


def _from_row(r) -> Fragment:
    array = lambda name: np.asarray(getattr(r, name), np.int64)
    prefix, suffix = (Tokens(*[array(f"{part}_{name}") for name in Tokens._fields]) for part in ("prefix", "suffix"))
    return Fragment(r.cut, prefix, r.groups, r.n_groups, array("pairs"), array("times"), suffix)


def _result(row: int, n_a: int, n_b: int, f: Fragment | None) -> tuple:
    if f is None or not n_a:
        return row, 0, 0, 0, _NONE, _NONE, ""
    text, n_groups, pairs, times = finished(f)
    return row, n_a, n_b, n_groups, pairs, times, hashlib.sha256(text[:-1].encode()).hexdigest()


def _short(rows: DataFrame) -> DataFrame:
    """``_DONE`` rows of texts (row, text) of one chunk."""
    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            texts = [" " + t if t else "" for t in pdf["text"].fillna("")]
            zeros = [0] * len(texts)
            found = _tokens(zeros, texts, zeros, texts)
            out = [_result(row, len(t.a) if t else 0, len(t.b) if t else 0, fragment(t) if t else None) for row, t in zip(pdf["row"], found, strict=True)]
            yield pd.DataFrame(out, columns=_names(_DONE))

    return map_texts(rows.select("row", "text"), work, _DONE)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _long(rows: DataFrame, tables: Tables, chunk: int) -> DataFrame:
    """``_DONE`` rows of texts of several chunks: fragments in any task, composed level by level."""
    def cut(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for row, text in zip(pdf["row"], pdf["text"], strict=True):
                yield pd.DataFrame([(row, k, *c) for k, c in enumerate(chunks(text, chunk))], columns=_names(pieces))

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            found = _tokens(pdf["at_a"], pdf["a"].tolist(), pdf["at_b"], pdf["b"].tolist())
            out = [_to_row(row, seq, len(t.a) if t else 0, len(t.b) if t else 0, fragment(t) if t else None)
                   for row, seq, t in zip(pdf["row"], pdf["seq"], found, strict=True)]
            yield pd.DataFrame(out, columns=_names(_STATE))

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        all_ok, whole = bool(g["ok"].all()), None
        for r in g.itertuples(index=False) if all_ok else ():
            own = _from_row(r)
            whole = own if whole is None else compose(whole, own)
        return pd.DataFrame([_to_row(int(g["row"].iloc[0]), int(g["seq"].iloc[0]) // FAN, int(g["n_a"].sum()), int(g["n_b"].sum()), whole)], columns=_names(_STATE))

    def close(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield pd.DataFrame([_result(r.row, r.n_a, r.n_b, _from_row(r) if r.ok else None) for r in pdf.itertuples(index=False)], columns=_names(_DONE))

    pieces = "row long, seq long, at_a long, a string, at_b long, b string"
    cut_up = tables.save(map_texts(rows.select("row", "text"), cut, pieces, rows=16), "chunks")
    most = cut_up.agg(F.max("seq")).first()[0]
    state = map_texts(cut_up.repartition("row", "seq"), work, _STATE, rows=16)
    while most:
        group = F.expr(f"seq div {FAN}").alias("group")
        state = state.withColumn("group", group).groupBy("row", "group").applyInPandas(lambda g: merge(g.drop(columns="group")), _STATE)
        most //= FAN
    return map_texts(state, close, _DONE, rows=16)


def align(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs`` (doc_id, text; other columns
    are not read).

    ``n_links``: pairs of a token of A and one of B that end together.  An id pair's count is its links in the whole table;
    ``n_best`` counts a row's links whose count is the highest of their B id, ``count_sum`` adds up its links' counts.  ``groups_sha256`` is the digest
    of the groups, ``a1,a2|b1;a3|b2,b3``.  Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no
    tokens: zeros and ''.  Marks of special tokens inside a text are text.  Repeated rows count each; a null doc_id is kept.  An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "alignment")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    size = F.length(F.coalesce("text", F.lit("")))
    done = tables.save(_short(rows.where(size < chunk)), "short")
    # long texts are few; they are written with their row numbers, so a chunk made again belongs to the same row
    held = tables.save(rows.where(size >= chunk), "held")
    if not held.isEmpty():
        done = done.unionByName(tables.save(_long(held, tables, chunk), "long"))
    ids = tables.save(rows.select("row", "doc_id"), "ids")

    links = done.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("count"))
    counts = tables.save(counts, "counts")
    token = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(token.alias("b")).agg(F.max("count").alias("most"))
    rated = tables.save(counts.withColumn("b", token).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "rated")
    known = F.broadcast(rated) if rated.count() <= SENT else rated
    sums = links.join(known, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum("times").alias("n_links"))
    out = ids.join(done.drop("pairs", "times"), "row").join(sums, "row", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", none("n_links"), none("n_best"), none("count_sum"), "groups_sha256")
