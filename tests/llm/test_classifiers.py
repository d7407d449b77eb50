import itertools
import zlib

import numpy as np
import pytest

from tests.llm.conftest import SF
from veilframe.llm import quality as Q
from veilframe.llm import toxicity as X
from veilframe.llm.queries import QUERIES

BIG = "/root/testdata/sf0.01"


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores))
    n1 = labels.sum()
    return (rank[labels == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(labels) - n1))


@pytest.mark.parametrize("name,label,threshold,least", [("op5_toxicity", "toxic", 0.3, 0.85), ("op8_quality", "quality", 0.7, 0.95)])
def test_held_out_accuracy(spark, name, label, threshold, least):
    rows = QUERIES[name](spark, BIG).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(np.array([s for s, _ in held]), np.array([y for _, y in held])) >= least


@pytest.mark.parametrize("run,label", [(X.score_toxicity, "toxic"), (Q.score_quality, "quality")])
def test_edges(spark, make_docs, run, label):
    rows = [(i, t) for i, t in enumerate(["good words here.", "bad | bad | bad", None, "", " \n", "x" * 300_000, "word\n" * 3000])] + [(None, "a"), (3, ""), (1, "bad | bad | bad")]
    docs = make_docs(rows, extra=["held_out", "label", "score"])
    labels = spark.createDataFrame([(0, 0, "x"), (1, 1, "x"), (1, 0, "x"), (2, None, "x"), (None, 1, "x"), (4, 0, "x")], f"doc_id long, {label} int, text string")
    got = run(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in run(docs, labels.limit(0)).collect()}) <= 4
    assert run(make_docs([]), labels).collect() == []


def test_learns_nothing_from_the_held_out_fold(spark, make_docs):
    docs = make_docs([(i, f"word{i % 7} text") for i in range(300)])
    flipped = spark.createDataFrame([(i, int((i % 7 == 0) ^ (zlib.crc32(str(i).encode()) % 4 == 2)), 0) for i in range(300)], "doc_id long, toxic int, quality int")
    honest = spark.createDataFrame([(i, int(i % 7 == 0), 0) for i in range(300)], "doc_id long, toxic int, quality int")
    a, b = ({r.doc_id: r.score for r in X.score_toxicity(docs, x).collect()} for x in (flipped, honest))
    assert a == b


def test_a_misspelling_scores_like_its_word():
    clean = [f"the sun is over hill number{i} and all the birds sing" for i in range(150)]
    toxic = [f"the sun is over worthless number{i} and all the birds sing" for i in range(150)]
    model = X.Model([(t, 0) for t in clean] + [(t, 1) for t in toxic])
    fine, plain, odd = model.scores(["the sun is over hill number7 and", "the sun is over worthless number7 and", "the sun is over worthles number7 and"])
    assert fine < 0.3 < min(plain, odd)


def test_subwords_of_many_texts_are_those_of_each():
    texts = ["one two, three", None, "", "déjà-vu x", "a"]
    bucket, word, at = X.subwords(texts)
    for i, t in enumerate(texts):
        b, w, a = X.subwords([t])
        own = (word >= at[i]) & (word < at[i + 1])
        assert a[-1] == at[i + 1] - at[i] and np.array_equal(bucket[own], b) and np.array_equal(word[own] - at[i], w)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    unary, ties = rng.normal(size=(3, 5, 2)), rng.normal(size=(2, 2))
    real = np.arange(5)[None, :] < np.array([5, 3, 1])[:, None]
    marginal, pairs = Q.forward_backward(unary, real, ties)
    total = np.zeros((2, 2))
    for d, n in enumerate((5, 3, 1)):
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            weight[path] = np.exp(sum(unary[d, t, y] for t, y in enumerate(path)) + sum(ties[a, b] for a, b in itertools.pairwise(path)))
        z = sum(weight.values())
        for t in range(n):
            assert marginal[d, t, 1] == pytest.approx(sum(w for p, w in weight.items() if p[t]) / z)
        for p, w in weight.items():
            for a, b in itertools.pairwise(p):
                total[a, b] += w / z
    assert pairs == pytest.approx(total)


def test_line_features_see_each_line():
    f, length, at = Q.line_features(["Good line here.\n\nA | B | C\n A | B | C", None, "x"])
    assert at.tolist() == [0, 3, 3, 4] and length.tolist() == [15, 9, 9, 1]
    assert f[0, 2] == 1 and f[1, 5] > 0 and f[2, 10] == f[1, 10] == 1 and f[0, 10] == 0


def test_the_sample_does_not_depend_on_partitions(spark, make_docs):
    from veilframe.llm.labelled import sample
    rows = [(i % 40, f"text {i}") for i in range(200)] + [(3, "long " * 5000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    one, many = (sample(make_docs(rows).repartition(n), labels, "toxic", 20) for n in (1, 7))
    assert one == many and len(one) == 20
    whole = {t for _, t in rows}
    assert all(t in whole for t, _ in one)
