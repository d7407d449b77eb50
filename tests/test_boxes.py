"""The histogram of class sizes and the cuts that reach k."""

import datetime as dt
import random

import pytest

from veilframe.operators import boxes as B
from veilframe.operators import privacy as X
from veilframe.plans import catalog

SF = "/root/testdata/sf0.001"


def _classes(rows, dims, out):
    """rows: (number per dim); out: (label per dim, k) of the same row."""
    found = {}
    for r, o in zip(rows, out):
        found.setdefault(o, []).append(r)
    for (*labels, k), members in found.items():
        assert len(members) == k
    return found


def _check(rows, out, k):
    """Every class has k rows, holds exactly the rows in its ranges' reach, and can't be cut along any column."""
    found = _classes(rows, range(len(rows[0])), out)
    for members in found.values():
        assert len(members) >= k or len(members) == len(rows)
        for d in range(len(rows[0])):
            values = sorted(m[d] for m in members)
            for at in set(values):
                low = sum(v <= at for v in values)
                assert low < k or len(values) - low < k
    return found


@pytest.mark.parametrize("sent", [B.SENT, 0])
def test_classes_have_k_rows_and_can_not_be_cut(spark, sent):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 1, 7, 8, 9, None]), rng.choice([0.0, -0.0, 2.5, float("nan"), rng.random()]), dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(40)))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id int, age int, `pay.x` double, day date").repartition(5)
    got = B.generalize_to_k(df, ["age", "pay.x", "day"], 6, sent)
    assert got.columns == ["id", "age", "pay.x", "day", "k"]
    by_id = {r["id"]: r for r in got.collect()}
    assert len(by_id) == got.count() == 400
    low = float("-inf")
    numbers = [(low if a is None else a, low if p != p else p, d.toordinal() - 719163) for _i, a, p, d in rows]
    labels = [tuple(by_id[i][c] for c in ("age", "pay.x", "day", "k")) for i in range(400)]
    found = _check(numbers, labels, 6)
    assert len(found) > 20
    for (*ranges, _k), members in found.items():
        for d, text in enumerate(ranges):
            ends = [low if e == "-" else float(e) for e in text.split("..")]
            assert ends == [min(m[d] for m in members), max(m[d] for m in members)]


def test_a_value_that_most_rows_share(spark):
    rows = [(5,)] * 60 + [(1,)] * 3 + [(9,)] * 4 + [(8,)] * 2
    out = B.generalize_to_k(spark.createDataFrame(rows, "q int"), ["q"], 4).collect()
    assert {(r["q"], r["k"]) for r in out} == {("1..5", 63), ("8..9", 6)} and len(out) == 69


def test_fewer_rows_than_k_and_none(spark):
    few = B.generalize_to_k(spark.createDataFrame([(1, "x"), (3, "y")], "q int, o string"), ["q"], 3)
    assert sorted(map(tuple, few.collect())) == [("1..3", "x", 2), ("1..3", "y", 2)]
    assert B.generalize_to_k(spark.createDataFrame([], "q int, o string"), ["q"], 3).count() == 0
    with pytest.raises(ValueError):
        B.generalize_to_k(spark.createDataFrame([("x",)], "q string"), ["q"], 3)


def test_the_registered_query_reaches_k(spark):
    from veilframe.session import read_table
    want = {r["c_custkey"]: (float(r["c_nationkey"]), float(r["c_acctbal"])) for r in read_table(spark, SF, "customer").collect()}
    got = {r["c_custkey"]: (r["c_nationkey"], r["c_acctbal"], r["k"]) for r in catalog.QUERIES["generalized_to_k"](spark, SF).collect()}
    assert set(got) == set(want)
    _check([want[i] for i in want], [got[i] for i in want], 5)


def test_histogram(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 3 + [(None,)], "q string")
    assert sorted(map(tuple, X.k_histogram(df, ["q"]).collect())) == [(1, 1, 1), (3, 2, 6)]
