import random

import pytest

import corpus_pipeline as P
from tests.llm.conftest import SF
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_packing import check
from tests.llm.test_substring_dedup import brute as repeats


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables like the given ones: prose, near copies, a passage in many documents, benchmark items and letterless texts."""
    rng = random.Random(8)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(5).collect()
    voc = [f"{a}{b}{c}" for a in "brstln" for b in "aeiou" for c in ("nd", "th", "re")]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    passage, texts = say(60), []
    for i in range(60):
        t = say(rng.randrange(30, 120)) + "."
        texts += [t + " " + passage if i % 6 == 0 else t]
        if i % 5 == 0:
            texts.append(t + " end")
        if i % 10 == 0:
            texts.append(say(40) + " " + items[i // 12].text + " " + say(40))
    texts += ["12 34 56", "", None, texts[3]]
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    stages = dict(P.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    now = texts(docs)

    docs = stages["language_id"](spark, docs, small)
    assert docs.columns == P.COLUMNS
    kept = {i: t for i, t in now.items() if any(c.isalpha() for c in t or "")}
    assert texts(docs) == kept

    docs = stages["near_dedup"](spark, docs, small)
    groups = near(kept, 5)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    assert texts(docs) == kept and docs.columns == P.COLUMNS

    docs = stages["substring_dedup"](spark, docs, small)
    got = {r.doc_id: r for r in docs.collect()}
    expected = repeats(kept, 20)
    assert {i: len((r.text or "").split()) for i, r in got.items()} == {i: n - gone for i, (n, gone, _) in expected.items()}
    assert all(r.n_chars == len(r.text) for r in got.values()) and docs.columns == P.COLUMNS
    assert all(got[i].text == kept[i] for i in kept if expected[i][1] == 0)
    kept = texts(docs)

    docs = stages["decontaminate"](spark, docs, small)
    gone = {i for i, _ in leaks(kept, items)}
    assert gone and texts(docs) == {i: t for i, t in kept.items() if i not in gone} and docs.columns == P.COLUMNS
    kept = texts(docs)

    check(stages["packing"](spark, docs, small).collect(), kept)
    check(P.run(spark, small).collect(), kept)


def test_order_of_stages():
    assert [name for name, _ in P.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontaminate", "packing"]


def test_stages_on_odd_rows(spark, small, make_docs):
    rows = make_docs([(None, "some words"), (1, "same text here"), (1, "same text here"), (2, None), (3, "")], extra=["rep", "hashes", "id"])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, small)
        assert out.columns == P.COLUMNS
        ids = sorted(str(r.doc_id) for r in out.collect())
        assert ids == {"language_id": ["1", "1", "None"], "near_dedup": ["1", "2", "3", "None"]}.get(name, ["1", "1", "2", "3", "None"])
        assert stage(spark, rows.limit(0), small).collect() == []


def test_rows_without_an_id_are_judged_each(spark, small):
    """A third of the rows without doc_id, one doc_id on many: near copies, repeats and benchmark items go all the same."""
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, 7).otherwise(F.col("doc_id")).cast("long"))
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    kept = [r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    stages = dict(P.STAGES)
    now = stages["language_id"](spark, odd, small)
    assert sorted(r.text for r in now.collect()) == sorted(kept)
    now = stages["near_dedup"](spark, now, small)
    left = [r.text for r in now.collect()]
    groups = near(dict(enumerate(kept)), 5)
    assert len(left) == len({c for _, c in groups.values()})
    now = stages["substring_dedup"](spark, now, small)
    assert not any(gone for _, gone, _ in repeats({i: r.text for i, r in enumerate(now.collect())}, 20).values())
    before = {i: r.text for i, r in enumerate(now.collect())}
    gone = {i for i, _ in leaks(before, items)}
    after = stages["decontaminate"](spark, now, small)
    assert gone and sorted(r.text for r in after.collect()) == sorted(t for i, t in before.items() if i not in gone)
    again = sorted(str(tuple(r)) for r in stages["substring_dedup"](spark, stages["near_dedup"](spark, odd.repartition(5), small), small).collect())
    assert again == sorted(str(tuple(r)) for r in stages["substring_dedup"](spark, stages["near_dedup"](spark, odd.repartition(3), small), small).collect())
