"""Merkle manifest of a table with one version of the tree per tampered row.

Rows are leaves; those of a language form a tree of fanout 8, and the languages' roots another one.  Trees are kept in aligned blocks of
8**4 nodes: a block is a small persistent tree in one task, its root is a node of the next storey, and so on up, so no task holds more
than a block whatever a language's size.

Going up, each storey hands its blocks' roots to the next.  Going down, each block receives its root's way to the top (the siblings on
either side of every ancestor).  A changed leaf makes a new version of its block by path copying: the leaf's ancestors are new nodes, all
others are shared with the first version; the version's root goes on along the block's way up.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.base import Tables

FANOUT, LEVELS = 8, 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SENT = 1_000_000           # rows of (partition, tree) starts that are broadcast at most
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WAY = "array<struct<before: string, after: string>>"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


class Node(NamedTuple):
    """A node of a persistent tree; never changed once made."""
    digest: str
    children: tuple[Node, ...] = ()


def build(digests: list[str], total: int, levels: int = LEVELS) -> Node:
    """The tree of a block, as high as a tree of ``total`` leaves needs but not above ``levels`` levels."""
    nodes, left = [Node(d) for d in digests], total
    for _ in range(levels):
        if left == 1:
            break
        runs = [tuple(nodes[k:k + FANOUT]) for k in range(0, len(nodes), FANOUT)]
        nodes, left = [Node(h(*[c.digest for c in run]), run) for run in runs], -(-left // FANOUT)
    return nodes[0]


def version(node: Node, level: int, at: int, digest: str) -> Node:
    """The tree with another digest at leaf ``at``: a copy of the ancestors, sharing all other nodes."""
    if level == 0:
        return Node(digest)
    step = FANOUT ** (level - 1)
    k = at // step
    children = (*node.children[:k], version(node.children[k], level - 1, at % step, digest), *node.children[k + 1:])
    return Node(h(*[c.digest for c in children]), children)


def height(node: Node) -> int:
    return 1 + height(node.children[0]) if node.children else 0


def way(node: Node, level: int, at: int) -> list[tuple[str, str]]:
    """The digests before and after each ancestor of leaf ``at`` in its run, lowest level first."""
    out = []
    for n in range(level - 1, -1, -1):
        k, at = divmod(at, FANOUT ** n)
        out.append(("".join(c.digest for c in node.children[:k]), "".join(c.digest for c in node.children[k + 1:])))
        node = node.children[k]
    return out[::-1]


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    """The top digest that a version's digest gives along a way."""
    for before, after in steps:
        digest = h(before, digest, after)
    return digest


def _field(name: str, value: Column | None = None) -> Column:
    text = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Hex digest of a row's fields; ``changed`` gives other values for some of them."""
    return F.sha2(F.concat(*[_field(name, changed.get(name)) for name in FIELDS]), 256)


def tampered() -> Column:
    """Whether 3 divides the crc32 of the id as decimal text; a row without id isn't tampered with."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))


def indexed(rows: DataFrame, order: list[str], tables: Tables, name: str) -> DataFrame:
    """``rows`` (tree, ...) with each row's place ``idx`` in its tree by ``order``, from 0, and its tree's size ``n``.

    Rows are range-partitioned; a partition's rows of a tree start where the earlier partitions' end.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())   # spreads equal rows over partitions
    by = [*order, "tie"]
    dealt = tables.save(tied.repartitionByRange("tree", *by).withColumn("part", F.spark_partition_id()), f"{name}-dealt")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    own = Window.partitionBy("tree")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tables.save(counts.select("tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("rows").over(own).alias("n")), f"{name}-starts")
    local = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*by)) - 1
    placed = dealt.withColumn("local", local).join(F.broadcast(starts) if starts.count() <= SENT else starts, ["tree", "part"])
    out = tables.save(placed.withColumn("idx", F.col("first") + F.col("local")).drop("local", "first", "part", "tie"), name)
    tables.drop(f"{name}-dealt", f"{name}-starts")
    return out


def _block(levels: int) -> Column:
    return F.expr(f"idx div {FANOUT ** levels}").alias("block")


def _storeys(nodes: DataFrame, tables: Tables, name: str, levels: int) -> list[DataFrame]:
    """The storeys over ``nodes`` (tree, idx, n, digest) as tables of the same columns; each tree's last one is its root alone."""
    def up(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        first = g.iloc[0]
        root = build(g["digest"].tolist(), int(first["n"]), levels)
        return pd.DataFrame({"tree": [first["tree"]], "idx": [int(first["block"])], "n": [-(-int(first["n"]) // FANOUT ** levels)], "digest": [root.digest]})

    found = [nodes.select("tree", "idx", "n", "digest")]
    while (found[-1].agg(F.max("n")).first()[0] or 1) > 1:
        level = found[-1].withColumn("block", _block(levels)).groupBy("tree", "block").applyInPandas(up, "tree string, idx long, n long, digest string")
        found.append(tables.save(level, f"{name}-{len(found)}"))
    return found


def _down(nodes: DataFrame, ways: DataFrame, levels: int) -> DataFrame:
    """(tree, idx, way, subroot) of each node, from its block's own way up."""
    def down(g: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        above = [(s["before"], s["after"]) for s in up["way"].iloc[0]]
        root = build(g["digest"].tolist(), int(g["n"].iloc[0]), levels)
        level = height(root)
        ways = [[{"before": b, "after": a} for b, a in way(root, level, k) + above] for k in range(len(g))]
        return pd.DataFrame({"tree": g["tree"], "idx": g["idx"], "way": ways, "subroot": up["subroot"].iloc[0]})

    return nodes.withColumn("block", _block(levels)).groupBy("tree", "block").cogroup(_by_block(ways)).applyInPandas(
        down, f"tree string, idx long, way {_WAY}, subroot string")


def _by_block(ways: DataFrame):
    return ways.withColumnRenamed("idx", "block").groupBy("tree", "block")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``docs`` (doc_id, source, lang, n_chars, text;
    other columns are not read).

    ``leaf`` is the row's digest, ``subroot`` its language's, ``root`` the table's; ``proof_sha256`` is the digest of the siblings on the
    row's way to the root.  ``folded_root`` is the root of the version in which the row's text is lower-cased (A-Z) if 3 divides its id's crc32, else of the row
    as it is; ``verified`` says whether it is the root.  Rows of a language stand in the order of doc_id, those without one
    first, equal ids by their digest; rows without lang are a language of their own, the first.  Null and empty texts differ.  An empty table gives no rows.
    A task holds a block of 8**levels nodes.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "merkle")
    lang = F.col("lang").cast("string")
    typed = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), lang.alias("lang"),
                        F.col("n_chars").cast("long"), F.col("text").cast("string").alias("text"))
    changed = F.when(tampered(), leaf_digest(text=F.translate("text", UPPER, LOWER)))
    # without lang: the first name; names keep the order of the languages
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = indexed(typed.select("doc_id", tree.alias("tree"), leaf_digest().alias("digest"), changed.alias("changed")), ["doc_id", "digest"], tables, "leaves")
    storeys = _storeys(leaves, tables, "lang", levels)
    subroots = tables.save(storeys[-1].select("tree", F.col("digest").alias("subroot")), "subroots")

    # the languages' roots are the leaves of the top tree
    top = indexed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest")), ["name"], tables, "top")
    tops = _storeys(top, tables, "tops", levels)
    head = tops[-1].first()
    root = head["digest"] if head else None
    ways = tops[-1].select("tree", "idx", F.array().cast(_WAY).alias("way"), F.lit(None).cast("string").alias("subroot"))
    for nodes in tops[-2::-1]:
        ways = _down(nodes, ways, levels)
    named = top.select("idx", "name", F.col("digest").alias("subroot"))
    ways = tables.save(ways.drop("subroot").join(named, "idx").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "way", "subroot"), "ways")
    for nodes in storeys[-2:0:-1]:
        ways = _down(nodes, ways, levels)

    def check(g: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        above = [(s["before"], s["after"]) for s in up["way"].iloc[0]]
        upper = "".join(b + a for b, a in above)
        first = build(g["digest"].tolist(), int(g["n"].iloc[0]), levels)
        level = height(first)
        rows = []
        for k, (doc, leaf, other) in enumerate(zip(g["doc_id"], g["digest"], g["changed"], strict=True)):
            proof = h(*[b + a for b, a in way(first, level, k)], upper)
            folded = fold(version(first, level, k, other or leaf).digest, above)
            rows.append((doc, leaf, up["subroot"].iloc[0], root, proof, folded, folded == root))
        return pd.DataFrame(rows, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    # ids as text: pandas would make floats of whole numbers beside nulls
    texts = leaves.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("block", _block(levels))
    out = texts.groupBy("tree", "block").cogroup(_by_block(ways)).applyInPandas(
        check, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    tables.drop("subroots", "top", *[f"tops-{k}" for k in range(1, len(tops))])
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
