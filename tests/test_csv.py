"""CSV files with quoted newlines in parallel, and the column types."""

import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.functions.text import as_text, col
from veilframe.sources import column_types as CT
from veilframe.sources import csv_records as R
from veilframe.sources import files as S

CELLS = ["", "plain", '"quoted"', '"two\nlines"', '"a ""doubled"" quote"', '"comma, inside"', '"\n"', '""', '"\n\n""\n"', "5 inch", 'a "b" c', '7"', '"x" y',
         '"long ' + "\n".join("line, %d" % i for i in range(40)) + '"', '"ends in quote"""', '"""', " lead", "trail ", '"Ünïcode\n✓"']


@pytest.fixture()
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "200b")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def _file(path, rows, end):
    body = "".join(",".join(r) + end for r in [["id", "a", "b"]] + rows)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(body)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_newlines_are_read_by_many_tasks_as_by_one(spark, tmp_out, small_splits, end):
    rng = random.Random(7)
    for n in range(2):
        cells = [c for c in CELLS if c != '"""']
        _file(f"{tmp_out}/f{n}.csv", [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(150)], end)
    want = spark.read.options(**S.CSV_READ_OPTIONS, multiLine="true").csv(tmp_out)
    got = S.read_csv(spark, tmp_out, multiline=True, na_tokens=False)
    assert got.columns == want.columns

    def key(r):
        return tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert R._lines(spark, tmp_out).rdd.getNumPartitions() > 40


def test_shuffled_lines_give_the_same_records(spark, tmp_out, small_splits):
    _file(f"{tmp_out}/f.csv", [[str(i), CELLS[i % 15], CELLS[i % 13]] for i in range(90)], "\n")
    one, other = (sorted(r[0] for r in R.records(spark, tmp_out, sent).collect()) for sent in (R.SENT, 0))
    assert one == other and len(one) == 90


def test_header_over_lines_empty_lines_and_open_ends(spark, tmp_out, small_splits):
    with open(f"{tmp_out}/f.csv", "w", newline="") as f:
        f.write('\n"id\n' + "x" * 200 + '",a\n1,2\n\n\r\n3,"never closed\n' + "y" * 200 + "\n4,5")
    got = sorted(r[0] for r in R.records(spark, tmp_out).collect())
    assert got == ["1,2", '3,"never closed\n' + "y" * 200 + "\n4,5"]


def test_a_file_of_a_header_alone_has_no_rows(spark, tmp_out):
    _file(f"{tmp_out}/f.csv", [], "\n")
    df = S.read_csv(spark, tmp_out, multiline=True)
    assert df.columns == ["id", "a", "b"] and df.count() == 0
    assert S.read_csv(spark, tmp_out, types="pandas").dtypes == [("id", "double"), ("a", "double"), ("b", "double")]


def test_split_states_are_those_of_one_reader(spark):
    rng = random.Random(3)
    rows, state, want = [], False, {}
    for block in range(200):
        a, b = rng.choice([(False, True), (False, True), (True, False), (True, True), (False, False)])
        rows.append(("f", block, 1, a, b))
        want[block] = state
        state = b if state else a
    starts = R.split_starts(spark.createDataFrame(rows, R.MOVES).repartition(5))
    assert {r["block"]: r["inside"] for r in starts.collect()} == want


COLUMNS = [["1", "2"], ["007", "+5", "-3"], ["1", ""], ["True", "false"], ["True", ""], ["True", "1"], ["1", "1.5"], ["1e3", "2"], ["9223372036854775807", "1"],
           ["9223372036854775808", "1"], ["9223372036854775808", "-1"], ["18446744073709551616", "1"], ["18446744073709551616", "1.5"], ["", ""], ["inf", "1"],
           ["Infinity", "-inf", "+INF"], [" 1", "2 "], [" 1.5", "2.5 "], ["1.", ".5", "."], ["1_0", "2"], ["1e400", "1"], ["tRue", "true"], ["-0", "1"], ["-0", ""],
           ["1d", "2"], ["0x10", "1"], ["1e", "2"], ["+", "1"], ["\uff11", "2"], ["9007199254740993", ""], ["\t1", "2"], ["1f", "2.0"], ["infi", "1"], ["1e-400", "2"],
           ["true ", "false"], ["NA", "3", "n/a"], ["nan", "x"], ["1" * 50, "2"]]


def test_columns_get_the_types_and_texts_of_pandas(spark):
    columns = {f"c{i}": (cells + [cells[0]] * 3)[:3] for i, cells in enumerate(COLUMNS)}
    rows = list(zip(*columns.values(), range(3)))
    df = spark.createDataFrame([tuple(c if c != "" else None for c in r) for r in rows], ", ".join(f"{c} string" for c in columns) + ", n int").repartition(3)
    got = CT.typed(S.with_na_tokens(df)).orderBy("n")
    texts = got.select(*[as_text(col(c), got.schema[c].dataType).alias(c) for c in columns]).collect()
    for c, cells in columns.items():
        want = pd.read_csv(io.StringIO("a,z\n" + "".join(f"{x},1\n" for x in cells)))["a"]
        assert [r[c] for r in texts] == [None if pd.isna(v) or v == "" else str(v) for v in want], cells
    assert dict(got.dtypes)["c0"] == "bigint" and dict(got.dtypes)["c2"] == "double" and dict(got.dtypes)["n"] == "int"


def test_column_kinds_of_awkward_names_and_none(spark):
    df = spark.createDataFrame([("1", "x")], "`a.b` string, `c` string")
    assert {r["column"]: r["kind"] for r in CT.column_kinds(df).collect()} == {"a.b": CT.WHOLE, "c": CT.TEXT}
    assert CT.column_kinds(spark.range(3)).count() == 0
    assert CT.typed(spark.range(3)).columns == ["id"]


def test_other_splits_in_the_second_scan_are_an_error(spark, tmp_out, small_splits):
    _file(f"{tmp_out}/f.csv", [[str(i), '"a\nb"', "c"] for i in range(60)], "\n")
    df = R.records(spark, tmp_out)
    for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(n, "300b")
    with pytest.raises(Exception, match="splits changed"):
        df.collect()
