import random

import numpy as np
import pytest

from tests.llm.conftest import SF
from veilframe.llm import decontaminate as D
from veilframe.llm.base import word_hashes
from veilframe.llm.queries import QUERIES


def distance(item, text):
    """Least word edit distance of the item to any stretch of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def words(t):
    return (t or "").encode().lower().split()


def brute(docs, items, share=0.2):
    out = set()
    for i, t in docs.items():
        w = words(t)
        for k, x in items.items():
            item = words(x)
            edits = int(share * len(item))
            if item and len(set(item) & set(w)) >= 0.3 * len(set(item)) and distance(item, w) <= edits:
                out.add((i, k))
    return out


def test_query_equals_brute_force(spark, table, real_docs):
    items = {r.item_id: r.text for r in table("benchmark").collect()}
    rows = QUERIES["op3_decontaminate"](spark, SF).collect()
    short = {i: t for i, t in real_docs.items() if len(t) < 6000}
    assert {(r.doc_id, r.item_id) for r in rows if r.doc_id in short} == brute(short, items)
    for r in rows:
        text, item = words(real_docs[r.doc_id]), words(items[r.item_id])
        assert distance(item, text[r.start_word:r.end_word]) == r.distance <= 0.2 * len(item)


@pytest.mark.parametrize("edits", [0, 0.1, 0.2])
def test_recall_of_edited_items(spark, make_docs, table, edits):
    rng = random.Random(5)
    items = {r.item_id: r.text for r in table("benchmark").collect()}
    docs = {}
    for i, t in items.items():
        w = t.split()
        for _ in range(int(edits * len(w))):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.pop(at), lambda: w.insert(at, "new"), lambda: w.__setitem__(at, "other")])()
        docs[i] = " ".join([f"a{rng.randrange(99)}" for _ in range(30)] + w + [f"b{rng.randrange(99)}" for _ in range(30)])
    got = {(r.doc_id, r.item_id) for r in D.contaminated(make_docs(docs.items()), table("benchmark")).collect()}
    assert sum((i, i) in got for i in items) >= 0.97 * len(items)


def test_edges(spark, make_docs):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "short item", "x"), (4, "short item", "x"), (None, "no id here", "x")],
                                  "item_id long, text string, doc_id string")
    rows = [(1, f"x {item} y {item}"), (2, None), (3, ""), (4, item.upper()), (5, "a short  item"), (6, "one two three"), (None, item), (7, item), (7, item), (8, "no id here")]
    got = [(r.doc_id, r.item_id, r.start_word, r.end_word, r.distance) for r in D.contaminated(make_docs(rows, extra=["item_id"]), bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1, 17, 0), (1, 1, 18, 34, 0), (4, 1, 0, 16, 0), (5, 4, 1, 3, 0), (5, 4, 1, 3, 0), (None, 1, 0, 16, 0),
                                           (7, 1, 0, 16, 0), (7, 1, 0, 16, 0), (8, None, 0, 3, 0)], key=str)
    assert D.contaminated(make_docs([]), bench).collect() == []
    assert D.contaminated(make_docs(rows), bench.limit(0)).collect() == []


def test_blocks_give_the_same(spark, make_docs, table, real_docs, monkeypatch):
    docs = make_docs(list(real_docs.items())[:60])
    whole = sorted(D.contaminated(docs, table("benchmark")).collect(), key=str)
    monkeypatch.setattr(D, "BLOCK_BYTES", 3000)
    assert sorted(D.contaminated(docs, table("benchmark")).collect(), key=str) == whole


def test_equal_windows_share_all_keys():
    w, _ = word_hashes(["a b c d e f g h i j k l m n o p q r s t"], lower=True)
    assert np.array_equal(D.keys(np.concatenate([w, w]), 14)[:, :4], D.keys(w, 14)[:, :4])


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 11, 14, 15, 16, 17, 18, 19, 20, 21, 24, 27, 28, 30, 40])
def test_candidates_of_each_length_at_the_full_share(n):
    rng, found = random.Random(n), 0
    for _ in range(300):
        item = [f"i{rng.getrandbits(40)}" for _ in range(n)]
        w = list(item)
        for _ in range(int(0.2 * n)):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.pop(at), lambda: w.insert(at, "new"), lambda: w.__setitem__(at, "other")])()
        text = " ".join([f"a{k}" for k in range(20)] + w + [f"b{k}" for k in range(20)])
        index, (words_, _) = D.Index([1], [" ".join(item)]), word_hashes([text], lower=True)
        _, starts, items = index.candidates(words_)
        found += bool(D.find(index, words_, starts, items, 0.2))
    assert found == 300 if n < D.SURE else found >= 0.99 * 300


def plain_matches(item, text, edits):
    """Best stretch first (of equal ones the leftmost), then on either side of it."""
    if len(text) < len(item) - edits or not len(item):
        return []
    far = D._ends(item, text)
    end = int(far.argmin())
    if far[end] > edits:
        return []
    best = np.flatnonzero(D._ends(item[::-1], text[:end][::-1]) == far[end])
    start = end - int(best[np.abs(best - len(item)).argmin()])
    return [*plain_matches(item, text[:start], edits), (start, end, int(far[end])), *[(end + a, end + b, d) for a, b, d in plain_matches(item, text[end:], edits)]]


def test_matches_equal_the_plain_recursion():
    rng = random.Random(6)
    for _ in range(400):
        m = rng.randrange(1, 9)
        item = np.array([rng.randrange(4) for _ in range(m)], np.uint64)
        text = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 60))], np.uint64)
        edits = rng.randrange(0, max(1, (m + 2) // 3))
        assert D.matches(item, text, edits) == plain_matches(item, text, edits)


def test_an_item_thousands_of_times_in_a_row(spark, make_docs):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    rows = D.contaminated(make_docs([(7, "one two three four five " * 20_000)]), bench).collect()
    assert sorted((r.start_word, r.end_word, r.distance) for r in rows) == [(5 * k, 5 * k + 5, 0) for k in range(20_000)]
