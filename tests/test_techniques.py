"""FIXTURES section 4: scalar transforms, input -> output."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX
from veilframe.functions.techniques import technique_column

M, H, G, N, R = FX.MASKING, FX.HASHING, FX.GENERALIZATION, FX.NULL_DELETION, FX.REDACTION

CASES = [
    (M, FX.EMAIL, "john.doe@example.com", "j*******@example.com"),
    (M, FX.EMAIL, "ali@example.com", "a**@example.com"),
    (M, FX.EMAIL, "a@b.c@d", "a@b.c@d"),
    (M, FX.EMAIL, "noat", "n**t"),
    (M, FX.EMAIL, "@domain.com", "@domain.com"),
    (M, FX.PHONE, "0300-1234567", "030*****567"),
    (M, FX.PHONE, "123456", "123456"),
    (M, FX.PHONE, "12-34", "*****"),
    (M, FX.CREDIT_CARD, "4111 1111 1111 1111", "************1111"),
    (M, FX.CREDIT_CARD, "12", "12"),
    (M, FX.CREDIT_CARD, "x", ""),
    (M, FX.FULL_NAME, "Ali Hassan", "A********n"),
    (M, None, "abc", "***"),
    (M, None, "abcd", "a**d"),
    (H, None, "35202-1234567-1", "52a834a2b4552d6818b7d5cf9ea4078c1373e1e482fe0d20789c0810bb7a37a2"),
    (G, FX.AGE, "34", "30-39"),
    (G, FX.AGE, "23.9", "20-29"),
    (G, FX.AGE, "0", "0-9"),
    (G, FX.AGE, "120", "120-129"),
    (G, FX.AGE, "1e2", "100-109"),
    (G, FX.AGE, "-5", "-10--1"),
    (G, FX.AGE, "-5.7", "-10--1"),
    (G, FX.AGE, "abc", "abc"),
    (G, FX.AGE, "23d", "23d"),
    (G, FX.AGE, " 23 ", "20-29"),
    (G, FX.AGE, "", ""),
    (G, FX.DOB, "15/03/1998", "1998"),
    (G, FX.DOB, "15/03/98", "15/03/98"),
    (G, FX.IP_ADDRESS, "192.168.1.5", "192.168.x.x"),
    (G, FX.IP_ADDRESS, "1.2.3", "1.2.3"),
    (G, FX.ADDRESS, "123 Main St, Lahore", "Lahore"),
    (G, FX.ADDRESS, "a,b,", ""),
    (G, FX.ADDRESS, "Lahore", "[Location Generalized]"),
    (G, None, "x", "[GENERALIZED]"),
    (N, None, "x", ""),
    (R, None, "x", "[REDACTED]"),
]


def _apply(spark, tech, pii_type, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = df.select("i", technique_column(F.col("v"), tech, pii_type).alias("o")).orderBy("i")
    return [r["o"] for r in out.collect()]


@pytest.mark.parametrize("tech,pii_type,value,expected", CASES)
def test_scalar(spark, tech, pii_type, value, expected):
    assert _apply(spark, tech, pii_type, [value]) == [expected]


@pytest.mark.parametrize("tech", [M, H, G, N, R])
@pytest.mark.parametrize("pii_type", [FX.EMAIL, FX.PHONE, FX.CREDIT_CARD, FX.DOB, FX.ADDRESS,
                                      FX.IP_ADDRESS, FX.FULL_NAME, None])
def test_blank_cells_unchanged(spark, tech, pii_type):
    blanks = [None, "", "  ", "\t"]
    assert _apply(spark, tech, pii_type, blanks) == blanks


def test_age_numeric_column(spark):
    df = spark.createDataFrame([(34,), (None,), (7,)], "age int")
    out = df.select(technique_column(F.col("age"), G, FX.AGE, df.schema["age"].dataType).alias("a"))
    assert [r["a"] for r in out.collect()] == ["30-39", None, "0-9"]


def test_nan_is_blank(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,)], "x double")
    out = df.select(technique_column(F.col("x"), R, None, df.schema["x"].dataType).alias("o"))
    assert [r["o"] for r in out.collect()] == [None, "[REDACTED]"]


def test_unknown_technique_returns_none():
    assert technique_column(F.col("v"), "Shuffle", None) is None


@pytest.mark.parametrize("v", [1e7, 3001234567.0, 4111111111111111.0, 12345678.25, 1e16, 1.5e300, 1e-3, 1e-4, 1.5e-4, 9.99e-4, 1e-5, 1.25e-7, 0.0, -0.0, 1.0, -1e7,
                               -12345678.5, -2.5e-4, -1e-5, 9999999.0, 9007199254740993.0, 123456.789, float("inf"), float("-inf")])
def test_doubles_print_as_in_python(spark, v):
    from veilframe.functions.text import as_text
    df = spark.createDataFrame([(v,)], "v double")
    assert df.select(as_text(F.col("v"), df.schema["v"].dataType)).first()[0] == str(v)


def test_number_cells_are_masked_by_their_plain_digits(spark):
    df = spark.createDataFrame([(3001234567.0, 4111111111111111.0)], "p double, c double")
    row = df.select(technique_column(F.col("p"), FX.MASKING, FX.PHONE, df.schema["p"].dataType).alias("p"),
                    technique_column(F.col("c"), FX.MASKING, FX.CREDIT_CARD, df.schema["c"].dataType).alias("c")).first()
    assert (row["p"], row["c"]) == ("300*****670", "*" * 13 + "1110")
