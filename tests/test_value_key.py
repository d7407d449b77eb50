"""K1 / K2 by value: one fake a value, in its type's own format."""

import datetime as dt
import ipaddress
import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import fakes as FK
from veilframe.functions import fixed as FX
from veilframe.functions import formats as FM
from veilframe.functions.techniques import age_band
from veilframe.operators import detect as D
from veilframe.operators import pseudo as K
from veilframe.operators import value_key as V
from veilframe.operators.transform import anonymize
from veilframe.plans.catalog_protect import TYPED, by_value
from veilframe.plans.people import people_df

SF = "/root/testdata/sf0.001"
SHAPES = {
    FX.FULL_NAME: r"[A-Z][a-z]+ [A-Z][a-z]{5} [A-Z][a-z]+", FX.EMAIL: r"[a-z]+\.[a-z]+\d{6}@example\.net", FX.PHONE: r"\+1-\d{3}-\d{3}-\d{4}",
    FX.ADDRESS: r"\d{1,4} [A-Za-z ]+, [A-Za-z]+ \d{5}", FX.DOB: r"\d{4}-\d\d-\d\d", FX.CREDIT_CARD: r"4000\d{12}", FX.STUDENT_ID: r"ID-\d{6}",
    FX.CNIC: r"\d{5}-\d{7}-\d", FX.IP_ADDRESS: r"\d+\.\d+\.\d+\.\d+", None: r"[A-Z]{2}\d{2}-[A-Z]{2}\d{2}",
}


def _fakes(spark, t, n, locale="en_US"):
    return [r[0] for r in spark.range(n).select(FM.fakes_of([t], F.lit(0), F.col("id"), locale).alias("f")).collect()]


@pytest.mark.parametrize("locale", list(FK.LOCALES))
@pytest.mark.parametrize("t", list(SHAPES))
def test_fakes_are_distinct_and_of_the_type_s_format(spark, t, locale):
    fakes = _fakes(spark, t, 3000, locale)
    assert len(set(fakes)) == 3000
    shape = r"\+49-1\d\d-\d{3}-\d{7}" if (t, locale) == (FX.PHONE, "de_DE") else SHAPES[t]
    assert all(re.fullmatch(shape, f) for f in fakes)
    assert not any(re.fullmatch(s, f) for other, s in SHAPES.items() if other != t for f in fakes)
    rule = FX.rule_for(t)
    assert rule is None or all(re.search(rule[3], f) for f in fakes)
    f = FM.format_of(t, locale)
    assert f.halves[0] * f.halves[1] == f.domain


def test_the_permutation_is_a_bijection_of_the_whole_domain(spark):
    for a, b in ((7, 5), (1, 9), (110, 200)):
        got = [r[0] for r in spark.range(a * b).select(FM.permuted(F.col("id"), F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), F.lit("key"))).collect()]
        assert sorted(got) == list(range(a * b))
        assert a == 1 or got != sorted(got)


def test_values_in_the_formats_are_real(spark):
    cards = _fakes(spark, FX.CREDIT_CARD, 300)
    for card in cards:
        digits = [int(c) for c in card[::-1]]
        assert (sum(digits[::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0
    assert all(ipaddress.ip_address(x).is_private for x in _fakes(spark, FX.IP_ADDRESS, 3000))
    clock = dt.date.fromisoformat(FK.FAKE_CLOCK)
    ages = [(clock - dt.date.fromisoformat(x)).days / 365.25 for x in _fakes(spark, FX.DOB, 3000)]
    assert min(ages) >= 18 and max(ages) <= 80.01


def test_private_blocks_are_used_to_their_ends(spark):
    f = FM.format_of(FX.IP_ADDRESS)
    ends = [0, (1 << 24) - 1, 1 << 24, (1 << 24) + (1 << 20) - 1, (1 << 24) + (1 << 20), f.domain - 1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ends], "x bigint").coalesce(1).select(FM.render(f, F.col("x"))).collect()]
    assert got == ["10.0.0.0", "10.255.255.255", "172.16.0.0", "172.31.255.255", "192.168.0.0", "192.168.255.255"]


def test_beyond_the_domain_a_tail_keeps_fakes_distinct(spark):
    n = FK.FAKE_DOB_SPAN_DAYS
    fakes = _fakes(spark, FX.DOB, 2 * n + 5)
    assert len(set(fakes)) == 2 * n + 5
    assert sum(x.endswith("~1") for x in fakes) == n and sum(x.endswith("~2") for x in fakes) == 5
    key = spark.createDataFrame([(f"o{i}", x, FX.DOB, 1) for i, x in enumerate(fakes)], "original string, fake string, pii_type string, n bigint")
    assert tuple(V.domain_use(key).first()) == (FX.DOB, 2 * n + 5, n, n + 5)


def test_the_first_configured_column_decides(spark):
    df = spark.createDataFrame([("a b", "x@y.zz"), ("Ali Hassan", " a b "), (None, ""), ("  ", "Ali Hassan")], "name string, mail string")
    name_first = by_value(df, [("name", FX.FULL_NAME), ("mail", FX.EMAIL)])
    rows = name_first.df.collect()
    assert rows[0]["name"] == rows[1]["mail"] and rows[1]["name"] == rows[3]["mail"]
    assert re.fullmatch(SHAPES[FX.FULL_NAME], rows[0]["name"]) and re.fullmatch(SHAPES[FX.EMAIL], rows[0]["mail"])
    assert (rows[2]["name"], rows[2]["mail"], rows[3]["name"]) == (None, "", "  ")
    assert {r.original: r.n for r in name_first.mapping.collect()} == {"a b": 2, "Ali Hassan": 2, "x@y.zz": 1}
    mail_first = by_value(df, [("mail", FX.EMAIL), ("name", FX.FULL_NAME)])
    assert {r.pii_type for r in mail_first.mapping.collect()} == {FX.EMAIL}
    back = K.restore(name_first.df, name_first.mapping, ["name", "mail"]).collect()
    assert [tuple(r) for r in back] == [("a b", "x@y.zz"), ("Ali Hassan", "a b"), (None, ""), ("  ", "Ali Hassan")]


def test_fakes_do_not_depend_on_how_rows_are_dealt(spark):
    p = people_df(spark, SF)
    one = V.value_mapping(p.coalesce(1), TYPED).collect()
    many = V.value_mapping(p.repartition(13, "segment"), TYPED).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_an_existing_key_is_continued(spark):
    p = people_df(spark, SF, blanks=False)
    first = V.value_mapping(p.where("k <= 40"), TYPED)
    both = V.value_mapping(p, TYPED, existing=first)
    old = {r.original: (r.fake, r.pii_type) for r in first.collect()}
    rows = both.collect()
    assert {r.original: (r.fake, r.pii_type) for r in rows if r.original in old} == old
    assert len({r.original for r in rows}) == len({r.fake for r in rows}) == len(rows) > len(old)
    assert {r.original for r in rows} == {r.original for r in V.value_mapping(p, TYPED).collect()}
    assert K.collisions(both).isEmpty()


def test_no_sort_in_one_task(spark, tmp_out):
    p = people_df(spark, SF)
    placed = V.dense_index(p.select(F.lit(1).alias("t"), F.sha2(F.col("k").cast("string"), 256).alias("h")), "t", "h", f"{tmp_out}/index")
    rows = sorted(placed.collect(), key=lambda r: r.h)
    assert [r.idx for r in rows] == list(range(len(rows)))
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()


def test_other_techniques_beside_fakes_by_value(spark):
    p = people_df(spark, SF)
    res = anonymize(p, [("full_name", FX.FULL_NAME, FX.FAKE_DATA), ("email", FX.EMAIL, FX.MASKING), ("age", FX.AGE, FX.GENERALIZATION)], consistent="value")
    plain = anonymize(p, [("email", FX.EMAIL, FX.MASKING), ("age", FX.AGE, FX.GENERALIZATION)])
    assert res.df.columns == p.columns and res.df.count() == p.count()
    assert sorted(map(str, res.df.drop("full_name").collect())) == sorted(map(str, plain.df.drop("full_name").collect()))
    with pytest.raises(ValueError):
        anonymize(p, [], consistent="both")


def test_detection_finds_the_fakes_types(spark):
    """As for originals, a rule of lower rank that also fits wins: CNIC and card numbers read as Phone, addresses of capital words as Full Name."""
    res = by_value(people_df(spark, SF, blanks=False), TYPED).df.select(*[F.col(c).alias(f"c{i}") for i, (c, _t) in enumerate(TYPED)])
    found = {r["column"]: r.pii_type for r in D.detect_values(res).collect()}
    assert [found[f"c{i}"] for i in range(9)] == [FX.FULL_NAME, FX.EMAIL, FX.PHONE, FX.PHONE, FX.DOB, FX.FULL_NAME, FX.IP_ADDRESS, FX.PHONE, FX.STUDENT_ID]


@pytest.mark.parametrize("v, band", [("-9223372036854775808", "-9223372036854775810--9223372036854775801"), ("9223372036854774784", "9223372036854774780-9223372036854774789"),
                                     ("9223372036854775807", "9223372036854775800-9223372036854775809"), ("-5", "-10--1"), ("34", "30-39")])
def test_age_bands_at_both_ends(spark, v, band):
    got = spark.createDataFrame([(v,)], "v string").select(age_band(F.col("v"))).first()[0]
    # float('9223372036854775807') is 2**63, beyond a bigint: unchanged
    assert got in (band, v) if v == "9223372036854775807" else got == band


@pytest.mark.parametrize("mode", [FX.MODE_ANONYMIZATION, FX.MODE_PSEUDONYMIZATION])
def test_a_run_by_value_leaves_its_key_only_in_the_key_folder(spark, tmp_out, mode):
    import glob
    import os

    from veilframe.plans.job import run
    from veilframe.session import checkpoint_dir
    df = spark.createDataFrame([("Jane Original", "Jane Original"), ("Tom Original", None)], "name string, alias string")
    df.write.parquet(f"{tmp_out}/in.parquet")
    out = run(spark, f"{tmp_out}/in.parquet", f"{tmp_out}/out", mode=mode, consistent="value",
              config=[("name", FX.FULL_NAME, FX.FAKE_DATA), ("alias", FX.EMAIL, FX.FAKE_DATA)])
    rows = spark.read.parquet(out.output).collect()
    assert out.rows == 2 and rows[0]["name"] == rows[0]["alias"] or rows[1]["name"] == rows[1]["alias"]
    shared = checkpoint_dir(spark).replace("file:", "")
    held = [f for base in (shared, f"{tmp_out}/out") for f in glob.glob(f"{base}/**/*.parquet", recursive=True) if os.path.isfile(f) and b"Original" in open(f, "rb").read()]
    assert all("pseudo_key" in f for f in held) and bool(held) == (mode == FX.MODE_PSEUDONYMIZATION)
