import hashlib
import random

import pytest

from tests.llm.conftest import SF
from veilframe.llm import substring_dedup as S
from veilframe.llm.queries import QUERIES


def brute(docs, size):
    seen, out = set(), {}
    for i in sorted(docs):
        w = (docs[i] or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            q = tuple(w[k:k + size])
            if q in seen:
                gone[k:k + size] = [True] * size
            seen.add(q)
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(left).hexdigest())
    return out


def test_query_equals_brute_force(spark, real_docs):
    rows = QUERIES["op6_substring_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute(real_docs, 20)


@pytest.mark.parametrize("chunk", [40, 2_000_000])
def test_small_windows_over_many_chunks(spark, make_docs, monkeypatch, chunk):
    rng = random.Random(7)
    docs = {i: " ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for i in range(60)}
    monkeypatch.setattr(S, "CHUNK", chunk)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest())
           for r in S.remove_repeats(make_docs(docs.items()).repartition(3), 4, slices=5).collect()}
    assert got == brute(docs, 4)


def test_text_and_spans_keep_white_space(make_docs):
    rows = [(2, "x\n a b c  d\te"), (1, "a b c"), (3, "a b c"), (4, None), (5, ""), (None, "q a b c r"), (7, "é a b c "), (7, "é a b c ")]
    got = {(r.doc_id, r.text): (r.n_words, r.n_removed, [tuple(s) for s in r.spans]) for r in S.remove_repeats(make_docs(rows, extra=["hashes", "slice"]), 3).collect()}
    assert got == {(1, "a b c"): (3, 0, []), (2, "x\n d\te"): (6, 3, [(1, 4)]), (3, ""): (3, 3, [(0, 3)]), (4, None): (0, 0, []), (5, ""): (0, 0, []),
                   (None, "q r"): (5, 3, [(1, 4)]), (7, "é a b c "): (4, 0, [])}


def test_carried_columns_and_empty_table(make_docs):
    assert S.remove_repeats(make_docs([]), 3).collect() == []
    row = S.remove_repeats(make_docs([(1, "a")]), carry=["lang", "n_chars"]).first()
    assert (row.lang, row.n_chars) == ("en", 1)


def test_very_long_text(make_docs):
    text = " ".join(f"w{i}" for i in range(60_000)) + " " + "z" * 3_000_000
    got = S.remove_repeats(make_docs([(1, text), (2, text + " end")])).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(60_001, 0), (60_002, 60_001)]


def test_the_largest_id_stays_itself(make_docs):
    top = 2 ** 63 - 1
    got = S.remove_repeats(make_docs([(top, "a b c d"), (1, "a b c"), (None, "x a b c"), (top - 1, "a b c")]), 3).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == sorted([(str(top), 3), ("1", 0), ("None", 3), (str(top - 1), 3)])


def test_slices_follow_the_text(spark, monkeypatch, make_docs):
    from veilframe.llm import substring_dedup as D
    texts = {k: " ".join(f"w{(k % 3) * 40 + j}" for j in range(60)) for k in range(12)}
    few = sorted(map(tuple, D.remove_repeats(make_docs(list(texts.items()))).select("doc_id", "n_words", "n_removed", "text").collect()))
    monkeypatch.setattr(D, "SLICE_BYTES", 7)      # more slices than windows
    many = sorted(map(tuple, D.remove_repeats(make_docs(list(texts.items()))).select("doc_id", "n_words", "n_removed", "text").collect()))
    assert few == many and sum(r[2] for r in few) > 0
