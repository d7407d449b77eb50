"""Every registered query of the catalogue against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tools.oracle_check import TABLES, digest  # noqa: E402
from veilframe.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"generalized_to_k"}      # held against brute force in test_boxes.py
    assert set(catalog.QUERIES) <= set(E.queries()) and set(catalog.SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_oracle(spark, duck, name):
    sdf = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(catalog.SQL[name])
    cols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(sdf.columns) == sorted(cols)
    assert len(rows) == len(orows) > 0
    assert digest(sdf.columns, rows)[0] == digest(cols, orows)[0]


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "k"
