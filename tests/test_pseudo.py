"""K1-K8: fakes, key table, restore, linkage."""

import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import fakes as FK
from veilframe.functions import fixed as FX
from veilframe.operators import pseudo as K
from veilframe.operators.transform import anonymize
from veilframe.plans.people import people_df

SF = "/root/testdata/sf0.01"
COLS = [("full_name", FX.FULL_NAME), ("email", FX.EMAIL)]

#: Shapes of the fakes; no two of them fit one text.
SHAPES = {
    FX.FULL_NAME: r"[A-Z][a-z]+ [A-Z][a-z]+ [A-P][a-p]{25}", FX.EMAIL: r"[a-z]+\.[a-z]+\.[0-9a-f]{26}@example\.net",
    FX.PHONE: r"\+1-555-\d{32}", FX.ADDRESS: r"\d{1,4} [A-Za-z ]+, Unit [A-P]{26}, [A-Za-z]+", FX.DOB: r"(19|20)\d\d-\d\d-\d\d#[0-9a-f]{26}",
    FX.CREDIT_CARD: r"4000\d{32}", FX.STUDENT_ID: r"ID-\d{32}", FX.CNIC: r"\d{5}-\d{7}-\d{20}", FX.IP_ADDRESS: r"fd[0-9a-f]{2}(:[0-9a-f]{4}){7}",
    None: r"[A-P]{2}\d{2}-[A-P]{2}\d{2}-[A-P]{26}",
}


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("pii_type", list(SHAPES))
def test_shapes_are_those_of_the_type_alone(spark, pii_type):
    fakes = [r[0] for r in spark.range(300).select(K.fake_column(F.concat(F.lit("v"), F.col("id").cast("string")), pii_type)).collect()]
    assert len(set(fakes)) == 300
    assert all(re.fullmatch(SHAPES[pii_type], f) for f in fakes)
    assert not any(re.fullmatch(other, f) for t, other in SHAPES.items() if t != pii_type for f in fakes)


def test_birth_dates_are_of_ages_18_to_80(spark):
    import datetime as dt
    clock = dt.date.fromisoformat(FK.FAKE_CLOCK)
    days = {r[0][:10] for r in spark.range(4000).select(K.fake_column(F.col("id").cast("string"), FX.DOB)).collect()}
    ages = [(clock - dt.date.fromisoformat(d)).days / 365.25 for d in days]
    assert min(ages) >= 18 and max(ages) <= 80.01


def test_locale_changes_pools_and_unknown_ones_are_refused(spark):
    df = spark.createDataFrame([("Ali Hassan",)], "full_name string")
    cfg = [("full_name", FX.FULL_NAME, FX.FAKE_DATA)]
    first = anonymize(df, cfg, locale="de_DE").df.first()[0].split()[0]
    assert first in FK.LOCALES["de_DE"]["first"]
    with pytest.raises(ValueError):
        anonymize(df, cfg, locale="xx")


def test_mapping_has_one_fake_per_type(spark):
    p = people_df(spark, SF, blanks=False, two_names=True)
    m = K.build_mapping(p, [("full_name", FX.FULL_NAME), ("manager_name", FX.EMAIL)])
    assert K.collisions(m).count() == 0
    assert m.count() == m.select("original", "pii_type").distinct().count()
    assert m.agg(F.sum("n")).first()[0] == 2 * p.count()


def test_consistent_fakes_across_rows_and_columns(spark):
    p = people_df(spark, SF, blanks=False, two_names=True)
    res = anonymize(p, [("full_name", FX.FULL_NAME, FX.FAKE_DATA), ("manager_name", FX.FULL_NAME, FX.FAKE_DATA)])
    joined = p.select("k", F.col("full_name").alias("o")).join(
        res.df.select("k", F.col("full_name").alias("f")), "k")
    per_original = joined.groupBy("o").agg(F.countDistinct("f").alias("n"))
    assert per_original.filter("n > 1").count() == 0
    both = res.df.alias("a").join(res.df.alias("b"), F.floor(F.col("a.k") / 2) == F.col("b.k")) \
        .select(F.col("a.manager_name").alias("m"), F.col("b.full_name").alias("f"))
    assert both.filter(F.col("m") != F.col("f")).count() == 0


def test_replacement_needs_no_shuffle(spark):
    p = people_df(spark, SF)
    assert _exchanges(anonymize(p, [(c, t, FX.FAKE_DATA) for c, t in COLS] + [("phone", FX.PHONE, FX.FAKE_DATA)]).df) == _exchanges(p)


def test_restore_round_trip_including_blanks(spark):
    p = people_df(spark, SF)
    res = anonymize(p, [(c, t, FX.FAKE_DATA) for c, t in COLS])
    for limit in (0, 1 << 30):
        back = K.restore(res.df, res.mapping, ["full_name", "email"], broadcast_bytes=limit)
        assert _rows(back, "k", "full_name", "email") == _rows(p, "k", "full_name", "email")


def test_existing_mapping_extends(spark):
    p = people_df(spark, SF)
    first = K.build_mapping(p.filter("k < 500"), COLS)
    old = first.withColumn("fake", F.concat(F.lit("kept "), "fake"))
    both = K.build_mapping(p, COLS, existing=old)
    assert both.where("fake LIKE 'kept %'").count() == old.count()
    assert _rows(both.where("fake NOT LIKE 'kept %'"), "original", "fake") == _rows(K.build_mapping(p, COLS), "original", "fake")
    same = K.build_mapping(p, COLS, existing=first)
    assert _rows(same, "original", "fake") == _rows(K.build_mapping(p, COLS), "original", "fake")
    assert K.build_mapping(p, []).count() == 0


def test_hash_link(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, a string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id bigint, b string")
    got = K.hash_link(a, "id", b, "id").collect()
    assert len(got) == 1 and got[0]["a"] == "y" and got[0]["b"] == "z"
