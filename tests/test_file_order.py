"""First rows and cells in file order, without a key."""

import os

import pytest
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX
from veilframe.operators import detect as D
from veilframe.operators.transform import preview
from veilframe.sources import file_order as FO
from veilframe.sources import files as S

RULES = [("name", FX.FULL_NAME, FX.REDACTION)]


def write_files(spark, home, fmt, files=7, rows=40):
    """Files a..g of several row groups or splits; the first cell of ``late`` stands in the last file."""
    for k in range(files):
        df = spark.range(k * rows, (k + 1) * rows, numPartitions=1)
        df = df.select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
                       F.when(F.col("id") >= (files - 1) * rows, F.concat(F.lit("a"), F.col("id").cast("string"), F.lit("@x.org"))).alias("late"))
        w = df.write.mode("overwrite").option("parquet.block.size", 1024).option("header", "true")
        getattr(w, fmt)(f"{home}/in {chr(97 + k)}")
    return [f"{home}/in {chr(97 + k)}" for k in range(files)]


def read(spark, paths, fmt):
    if fmt == "parquet":
        return spark.read.parquet(*paths)
    return S.with_na_tokens(spark.read.options(**S.CSV_READ_OPTIONS).csv(paths))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_first_rows_are_those_of_the_files(spark, tmp_out, fmt):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")       # several splits a file, packed by size
    try:
        df = read(spark, write_files(spark, tmp_out, fmt), fmt)
        assert [int(r["id"]) for r in FO.first_rows(df, 95, "row").orderBy("row").collect()] == list(range(95))
        assert [int(r["id"]) for r in FO.first_rows(df.where("id % 2 = 1"), 50, "row").orderBy("row").collect()] == list(range(1, 101, 2))
        assert FO.first_rows(df, 1000, "row").count() == 280            # fewer rows than asked for: all of them
        assert [tuple(r) for r in preview(df, RULES, n=2).orderBy("row").collect()] == [(1, "n0", "[REDACTED]"), (2, "n1", "[REDACTED]")]
        cells = D.value_cells(df, ["id", "name", "late"], sample_rows=3).collect()
        assert sorted(map(tuple, cells)) == sorted([("id", str(k)) for k in range(3)] + [("name", f"n{k}") for k in range(3)]
                                                   + [("late", f"a{k}@x.org") for k in range(240, 243)])
        found = {r["column"]: r["pii_type"] for r in D.detect_values(df, ["name", "late"], sample_rows=10).collect()}
        assert found == {"name": None, "late": FX.EMAIL}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_after_the_first_rows_are_not_read(spark, tmp_out):
    paths = write_files(spark, tmp_out, "parquet")
    schema = spark.read.parquet(paths[0]).schema
    for folder in paths[1:]:
        for f in os.listdir(folder):
            if f.endswith(".parquet"):
                with open(f"{folder}/{f}", "wb") as broken:
                    broken.write(b"no parquet")
                if os.path.exists(f"{folder}/.{f}.crc"):
                    open(f"{folder}/.{f}.crc", "wb").close()
    df = spark.read.schema(schema).parquet(*paths)
    assert [r["id"] for r in FO.first_rows(df, 5, "row").orderBy("row").collect()] == list(range(5))
    assert D.value_cells(df, ["name"], sample_rows=40).count() == 40


def test_clashing_names_and_empty_tables(spark, tmp_out):
    df = spark.range(9).selectExpr("id AS row", "id AS __row", "id AS __place", "id AS _metadata", "concat('n', id) AS name").coalesce(1)
    df.write.parquet(f"{tmp_out}/t")
    t = spark.read.parquet(f"{tmp_out}/t")
    assert [tuple(r) for r in preview(t, RULES, n=2).orderBy("row").collect()] == [(1, "n0", "[REDACTED]"), (2, "n1", "[REDACTED]")]
    assert D.value_cells(t, ["__place", "name"], sample_rows=2).count() == 4
    none = t.where("row < 0")
    assert preview(none, RULES).count() == 0 and D.value_cells(none, ["name"], sample_rows=2).count() == 0


def test_rows_without_files_need_a_key(spark):
    df = spark.createDataFrame([("a",)], "name string")
    for call in (lambda: preview(df, RULES), lambda: D.detect_values(df, ["name"], sample_rows=1)):
        with pytest.raises(ValueError, match="key"):
            call()
