import math

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from veilframe.llm import language_id as L
from veilframe.llm.queries import QUERIES

ROW = "id long, text string, declared string, host string, suffix string"


def test_query(spark, table):
    rows = QUERIES["op9_language_id"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in table("documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert sum(r.language == lang[r.doc_id] for r in rows) >= 0.99 * len(rows)
    assert all(r.kept for r in rows)


def test_text_alone_tells_held_out_rows(spark, table):
    docs = table("documents")
    known = L.document_rows(docs.where("doc_id % 2 = 0"))
    blind = L.document_rows(docs.where("doc_id % 2 = 1").drop("lang", "source").selectExpr("*", "CAST(null AS string) AS lang", "CAST(null AS string) AS source"))
    lang = {r.doc_id: r.lang for r in docs.where("doc_id % 2 = 1").collect()}
    rows = L.identify(known.unionByName(blind)).where("id % 2 = 1").collect()
    assert sum(r.language == lang[r.id] for r in rows) >= 0.97 * len(rows)


def test_text_overrules_a_wrong_declaration(spark, table):
    docs = table("documents")
    wrong = L.document_rows(docs.where("lang = 'de' AND n_chars > 500").limit(5)).selectExpr("id + 1000000 AS id", "text", "'fr' AS declared", "host", "suffix")
    rows = L.identify(L.document_rows(docs).unionByName(wrong)).where("id >= 1000000").collect()
    assert len(rows) == 5 and all(r.language == "de" for r in rows)


def test_host_priors_are_smoothed(spark):
    data = [(1, "", "en", "a.fr", "fr")] * 30 + [(1, "", "fr", "b.fr", "fr")] * 10 + [(1, "", "fr", None, None)] * 20
    rows = L.host_priors(spark.createDataFrame(data, ROW), ["en", "fr"]).collect()
    got = {r.host: [math.exp(x) for x in r.prior] for r in rows}
    whole = [(30 + 20 * 0.5) / 80, (30 + 20 * 0.5) / 80]
    suffix = [(30 + 20 * whole[0]) / 60, (10 + 20 * whole[1]) / 60]
    none = [(0 + 20 * whole[0]) / 40, (20 + 20 * whole[1]) / 40]
    assert got["a.fr"] == pytest.approx([(30 + 20 * suffix[0]) / 50, 20 * suffix[1] / 50])
    assert got["b.fr"] == pytest.approx([20 * suffix[0] / 30, (10 + 20 * suffix[1]) / 30])
    assert got[None] == pytest.approx([20 * none[0] / 40, (20 + 20 * none[1]) / 40])


def test_prior_and_declaration_decide_where_the_text_is_silent(spark):
    data = [(i, "the cat and the dog", "en", "x.org", "org") for i in range(40)] + [(100 + i, "le chat et le chien", "fr", "y.fr", "fr") for i in range(40)]
    data += [(900, "zzz", None, "y.fr", "fr"), (901, "zzz", None, "new.fr", "fr"), (902, "zzz", None, "x.org", "org"), (903, "12 34", "fr", "y.fr", "fr"), (904, None, None, None, None)]
    got = {r.id: r for r in L.identify(spark.createDataFrame(data, ROW)).where("id >= 900").collect()}
    assert [got[i].language for i in (900, 901, 902)] == ["fr", "fr", "en"] and 0.5 < got[901].posterior < got[900].posterior < 0.99
    assert [(got[i].language, got[i].posterior, got[i].kept) for i in (903, 904)] == [("und", 0.0, False)] * 2


def test_edges(spark, make_docs):
    empty = spark.createDataFrame([], ROW)
    assert L.identify(empty).collect() == []
    undeclared = spark.createDataFrame([(1, "some text", None, None, None), (None, "x", None, "h", None)], ROW)
    assert [(r.language, r.kept) for r in L.identify(undeclared).collect()] == [("und", False)] * 2
    clash = make_docs([(1, "the cat"), (1, "the cat"), (None, None)], extra=["id", "host", "prior", "logs", "declared"])
    assert [r.kept for r in L.identify(L.document_rows(clash)).orderBy("n_letter_words").collect()] == [False, True, True]


def test_pages(spark, table):
    rows = L.page_rows(table("pages"))
    one, page = rows.where("id = 0").first(), table("pages").where("page_id = 0").first()
    assert f'<html lang="{one.declared}">' in page.html and f"//{one.host}/" in page.url and one.host.endswith("." + one.suffix)
    assert "<" not in one.text and "track(" not in one.text
    found = L.identify(rows).collect()
    assert sum(r.language == r.declared for r in found) >= 0.97 * len(found)
    odd = spark.createDataFrame([(1, None, None), (2, "no address", "<p>x"), (3, "https://u@h.example:8/x", "<HTML LANG=de-AT>")], "page_id long, url string, html string")
    assert [(r.declared, r.host, r.suffix) for r in L.page_rows(odd).orderBy("id").collect()] == [(None, None, None), (None, None, None), ("de", "h.example", "example")]


def test_every_language_gets_its_sample(spark):
    # 600 rows of a hot language beside 30 of a rare one: as many rows of each, by the smallest hashes, copies counted once
    data = [(i, f"the cat {i}", "en", None, None) for i in range(600)] * 2 + [(1000 + i, f"le chat {i}", "fr", None, None) for i in range(30)] + [(5000, "12", "en", None, None)]
    rows = spark.createDataFrame(data, ROW)
    for number, want in ((40, {"en": 20, "fr": 20}), (100, {"en": 50, "fr": 30})):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(L, "SAMPLE_ROWS", number)
            got = L.sampled(rows.where("text <> '12'"), ["en", "fr"]).collect()
        assert {x: sum(r.declared == x for r in got) for x in ("en", "fr")} == want and len({r.id for r in got}) == len(got)


def test_a_share_too_small_for_a_million_still_gives_a_sample(spark, table, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_ROWS", 0)  # the share of a language of endless rows
    rows = L.identify(L.document_rows(table("documents"))).collect()
    lang = {r.doc_id: r.lang for r in table("documents").collect()}
    assert sum(r.language == lang[r.id] for r in rows) >= 0.97 * len(rows)


def test_a_language_without_letters_has_no_model(spark):
    data = [(i, "the cat and the dog", "en", None, None) for i in range(20)] + [(50, "12", "fr", None, None), (51, None, "de", None, None), (52, "жук", None, None, None)]
    assert {r.id: r.language for r in L.identify(spark.createDataFrame(data, ROW)).where("id >= 50").collect()} == {50: "und", 51: "und", 52: "en"}
    flat = L.TextModel(["en", "fr"], [("a cat", "en"), ("12", "fr")])
    assert len(set(flat.table[:, 1])) == 1 and len(set(flat.table[:, 0])) > 1


@pytest.mark.parametrize("block", [256, 60])
def test_more_than_a_hundred_languages(spark, monkeypatch, block):
    # 130 languages, each of words of its own; the rarer ones come after the 100th by frequency
    monkeypatch.setattr(L, "BLOCK", block)
    word = lambda k, j: chr(0x4E00 + 40 * k + j) + chr(0x4E00 + 40 * k + j + 1)
    data = [(100 * k + j, " ".join(word(k, (j + x) % 30) for x in range(20)), f"x{k:03d}", f"h{k % 7}", None) for k in range(130) for j in range(6 if k < 100 else 3)]
    data += [(100 * k + 99, " ".join(word(k, x) for x in range(20)), None, None, None) for k in range(130)]
    rows = L.identify(spark.createDataFrame(data, ROW)).collect()
    assert len(rows) == len(data)
    assert [r for r in rows if r.language != f"x{r.id // 100:03d}" or not r.kept] == []


def test_a_language_without_a_letter_trigram_of_its_own(spark):
    data = [(i, "the cat and the dog", "en", None, None) for i in range(30)] + [(99, "😀" * 30 + "word", "xx", None, None), (98, "\U00010400" * 5, "yy", None, None)]
    got = {r.id: r.language for r in L.identify(spark.createDataFrame(data, ROW)).collect()}
    assert got[0] == "en" and len(got) == 32


def test_the_sample_is_the_smallest_hashes_whatever_the_bound(spark, monkeypatch):
    rows = spark.range(30_000).select("id", F.concat(F.lit("word"), (F.col("id") % 9_000).cast("string")).alias("text"),
                                      F.when(F.col("id") % 10 == 0, "fr").otherwise("en").alias("declared"))
    rows = rows.unionByName(rows.where("id < 500"))      # repeated rows count once
    hashed = rows.withColumn("hash", F.xxhash64("id", "text")).distinct().toPandas()
    want = {(d, i) for d, g in hashed.groupby("declared") for i in g.nsmallest(1000, "hash")["id"]}
    for margin in (4, 1, 0.5):      # the smaller, the more often too few lie under the bound
        monkeypatch.setattr(L, "MARGIN", margin)
        got = L.sampled(rows, ["en", "fr"]).collect()
        assert {(r["declared"], r["id"]) for r in got} == want and len(got) == len(want)


def test_pages_use_host_and_suffix(spark):
    rows = QUERIES["pages_language_id"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert rows.where("kept").count() > 0
    assert L.page_rows(spark.read.parquet(f"{SF}/pages.parquet")).where("suffix IS NOT NULL").count() > 0
