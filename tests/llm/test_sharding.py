import zlib

from tests.llm.conftest import SF
from veilframe.llm.queries import QUERIES
from veilframe.llm.sharding import balanced_shards


def check(rows, n):
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(n):
        own = [r for r in rows if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / n) <= largest


def test_query(spark, real_docs):
    rows = QUERIES["op7_sharding"](spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in real_docs.items()}
    check(rows, 24)
    ordered = sorted(rows, key=lambda r: r.doc_id)
    assert [(r.shard, r.slot) for r in ordered] == sorted((r.shard, r.slot) for r in rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_edges(make_docs):
    rows = balanced_shards(make_docs([(3, None), (1, ""), (1, ""), (None, "é"), (2, "x" * 500)], extra=["size", "shard", "part", "tie"]), 4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == [
        (False, 1, 8, 0), (False, 1, 8, 0), (False, 2, 508, zlib.crc32(b"x" * 500)), (False, 3, 8, 0), (True, 0, 10, zlib.crc32("é".encode()))]
    assert balanced_shards(make_docs([])).collect() == []


def test_a_third_without_id_is_spread(make_docs):
    rows = balanced_shards(make_docs([(None if i % 3 == 0 else i, "same") for i in range(3000)]).repartition(6), 24).collect()
    check(rows, 24)
