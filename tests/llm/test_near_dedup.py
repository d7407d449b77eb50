import random

import numpy as np
import pytest

from veilframe.llm import near_dedup as N
from veilframe.llm.queries import QUERIES
from tests.llm.conftest import SF


def sets_of(docs, size):
    out = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        out[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    return out


def brute(docs, size, percent=80):
    sets = sets_of(docs, size)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_equals_brute_force(spark, real_docs):
    rows = QUERIES["op1_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(real_docs, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_group_of_near_copies_loses_no_link(make_docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    docs = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs[i] = " ".join(w)
    docs |= {200 + i: " ".join(rng.choice(words) for _ in range(n)) for i, n in enumerate((1, 2, 3, 30, 30))}
    assert result(N.near_duplicates(make_docs(docs.items()), 2)) == brute(docs, 2)


def test_edges(make_docs):
    same = "one two three four five six"
    rows = [(5, same), (3, same.upper()), (3, same.upper()), (9, None), (8, ""), (7, " \t\n"), (None, same), (11, "word"), (12, "WORD"), (13, "wörd x")]
    got = sorted(N.near_duplicates(make_docs(rows, extra=["rep", "key", "component_id"])).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [
        (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
        (11, 1, 11, True), (12, 1, 11, False), (13, 1, 13, True), (None, 2, None, True)]


def test_one_document_of_two_texts_joins_their_groups(make_docs):
    got = result(N.near_duplicates(make_docs([(1, "a b c"), (2, "x y z"), (3, "a b c"), (3, "x y z")]), 2))
    assert {k: v[1] for k, v in got.items()} == {1: 1, 2: 1, 3: 1}


def test_empty_table(make_docs):
    assert N.near_duplicates(make_docs([])).collect() == []


def test_percent_below_the_bands_is_refused(make_docs):
    with pytest.raises(ValueError):
        N.near_duplicates(make_docs([]), percent=50)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(3)
    for n in (3, 30, 300, 30_000):
        found = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = x.copy()
            y[: n // 3] = rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
            a, b = (N.registers(np.unique(N.mix(v))) for v in (x, y))
            found.append(float(N.jaccard_estimate(a, b, np.array(n), np.array(n))))
        shared = n - n // 3
        assert abs(np.mean(found) - shared / (2 * n - shared)) < 0.03
    a, b = (N.registers(N.mix(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))) for _ in range(2))
    assert N.jaccard_estimate(a, b, np.array(5000), np.array(5000)) < 0.02


def test_one_document_of_three_texts_joins_all_their_groups(make_docs):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = make_docs([(1, a), (2, b), (3, c), (5, a), (5, b), (5, c), (7, d), (8, d)])
    got = {(r.doc_id, r.component_id) for r in N.near_duplicates(rows).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (7, 7), (8, 7)}


def thue_morse(n):
    """Two different words of 2**n letters that any polynomial hash modulo 2**64 takes for one from n = 11 on."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_structured_words_are_told_apart(make_docs):
    from veilframe.llm import substring_dedup
    a, b = thue_morse(11)
    rest = " ".join(f"w{i}" for i in range(19))
    got = N.near_duplicates(make_docs([(1, a), (2, b)]), size=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]
    cut = substring_dedup.remove_repeats(make_docs([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in cut) == [(1, 0), (2, 0), (3, 20)]
