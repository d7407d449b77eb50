import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from veilframe.llm import merkle
from veilframe.llm.queries import QUERIES

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def ascend(nodes, at):
    """(root, siblings of node ``at`` as (before, after) by level) of a list of digests."""
    steps = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8:at // 8 * 8 + 8]
        steps.append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
        nodes, at = [H("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 8)], at // 8
    return nodes[0], steps


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in names:
        trees[x].sort(key=lambda t: t[:3])
    subroots = [ascend([t[2] for t in trees[x]], 0)[0] for x in names]
    root = ascend(subroots, 0)[0]
    out = []
    for k, x in enumerate(names):
        above = ascend(subroots, k)[1]
        for at, (_, _, own, r) in enumerate(trees[x]):
            steps = ascend([t[2] for t in trees[x]], at)[1] + above
            now = leaf(r, lower(r["text"])) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else own
            for before, after in steps:
                now = H(before + now + after)
            out.append((r["doc_id"], own, subroots[k], root, H("".join(b + a for b, a in steps)), now, now == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_query(spark, table):
    rows = [r.asDict() for r in table("documents").collect()]
    result = got(QUERIES["op13_merkle_manifest"](spark, SF))
    assert result == plain(rows)
    assert 0 < sum(not r[-1] for r in result) < len(result)


def test_edges(spark, make_docs):
    rows = [(3, None), (1, ""), (1, ""), (1, "Other"), (None, "No id"), (None, "No id"), (12, "É A"), (7, "x" * 300_000 + "A")]
    df = make_docs(rows, extra=["tree", "idx", "digest", "block", "way"])
    df = df.withColumn("lang", F.when(F.col("doc_id") == 3, F.lit(None)).when(F.col("doc_id") == 12, "").when(F.col("doc_id") == 7, "é").otherwise(F.col("lang")))
    df = df.withColumn("source", F.when(F.col("doc_id") == 12, F.lit(None)).otherwise(F.col("source"))).withColumn("n_chars", F.when(F.col("doc_id") != 12, F.col("n_chars")))
    assert got(merkle.manifest(df)) == plain([r.asDict() for r in df.collect()])
    assert merkle.manifest(make_docs([])).collect() == []
    one = make_docs([(5, "alone")])
    assert got(merkle.manifest(one)) == plain([r.asDict() for r in one.collect()])


@pytest.mark.parametrize("n", [9, 65, 70])
def test_storeys_of_small_blocks(make_docs, n):
    """Blocks of 8 leaves, so that trees have several storeys, up and down."""
    df = make_docs([(i, f"Text {i}") for i in range(n)]).withColumn("lang", F.when(F.col("doc_id") < 9, F.concat(F.lit("l"), F.col("doc_id"))).otherwise("en"))
    assert got(merkle.manifest(df, levels=1)) == plain([r.asDict() for r in df.collect()])


def test_two_storeys(spark, make_docs):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"),
                                  F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert got(merkle.manifest(df)) == plain([r.asDict() for r in df.collect()])


def test_a_version_shares_untouched_nodes():
    tree = merkle.build([H(str(k)) for k in range(600)], 600)
    changed = merkle.version(tree, 4, 77, H("new"))

    def nodes(node):
        return [node, *[x for c in node.children for x in nodes(c)]]

    first = {id(x) for x in nodes(tree)}
    fresh = [x for x in nodes(changed) if id(x) not in first]
    assert len(fresh) == 5          # the leaf and its four ancestors
    assert merkle.fold(H("new"), merkle.way(tree, 4, 77)) == changed.digest
    assert merkle.build([H("new") if k == 77 else H(str(k)) for k in range(600)], 600).digest == changed.digest
