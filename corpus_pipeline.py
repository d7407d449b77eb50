"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next one.

Every stage reads all that its predecessor kept and returns the columns of ``documents``; the last one returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, language_id, near_dedup, packing, substring_dedup
from veilframe.llm.base import Tables, prepare
from veilframe.llm.merkle import indexed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SENT = 1_000_000  # row numbers that are broadcast at most, 8 bytes each


def _numbered(docs: DataFrame, tables: Tables) -> DataFrame:
    """``docs`` with ``row``, a number of each row's own: its doc_id where every row has one of its own, else its place in
    the order of (doc_id, rows without one last; hash of the row), written once.

    The stages decide by it, so rows without doc_id and rows that share one are judged each for itself.
    """
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:
        return docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("row"))
    keyed = docs.select(*COLUMNS, F.lit("").alias("tree"), F.col("doc_id").isNull().alias("none"), F.xxhash64(*COLUMNS).alias("hash"))
    return indexed(keyed, ["none", "doc_id", "hash"], tables, "numbered").select(*COLUMNS, F.col("idx").cast("long").alias("row"))


def _without(rows: DataFrame, gone: DataFrame, tables: Tables) -> DataFrame:
    """The documents of ``rows`` but those whose number is in ``gone`` (row), which is written first and broadcast where it is short."""
    gone = tables.save(gone.distinct(), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= SENT else gone, "row", "left_anti").select(COLUMNS)


def _as_id(rows: DataFrame) -> DataFrame:
    """The rows with their number in place of doc_id."""
    return rows.drop("doc_id").withColumnRenamed("row", "doc_id")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or of a doubtful language go, whether or not they have a doc_id."""
    prepare(spark)
    tables = Tables(spark, "language-stage")
    rows = _numbered(docs, tables)
    found = language_id.identify(language_id.document_rows(_as_id(rows)))
    return _without(rows, found.where("NOT kept").select(F.col("id").alias("row")), tables)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8) stays, the one of the smallest doc_id; rows without
    doc_id come after all others.  Rows that share a doc_id are compared like any others."""
    prepare(spark)
    tables = Tables(spark, "near-stage")
    rows = _numbered(docs, tables)
    found = near_dedup.near_duplicates(_as_id(rows))
    return _without(rows, found.where("NOT kept").select(F.col("doc_id").alias("row")), tables)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that also start earlier are cut out of the texts; no document goes.

    Earlier: in a row of a smaller doc_id, or further up in the row; rows that share a doc_id and rows without one cut each other too.
    """
    prepare(spark)
    rows = _numbered(docs, Tables(spark, "cut-stage")).withColumnRenamed("doc_id", "own")
    out = substring_dedup.remove_repeats(rows.withColumnRenamed("row", "doc_id"), carry=["own", "lang", "source"])
    return out.select(F.col("own").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, up to a fifth of its words edited, go, whether or not they have a doc_id; of rows that share a doc_id only those that hold one."""
    prepare(spark)
    tables = Tables(spark, "leak-stage")
    rows = _numbered(docs, tables)
    hits = decontaminate.contaminated(_as_id(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, hits.select(F.col("doc_id").alias("row")), tables)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 1024 tokens."""
    prepare(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: The stages compare whole texts by fitted models, fuzzy methods and a tokenizer that SQL has no functions for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir/documents.parquet; returns the last one's rows."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
