"""The labelled sample that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2: these labels are never learned from.  A row without doc_id isn't held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("long").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list[tuple[str, int]]:
    """(whole text, label) of at most ``rows`` labelled documents outside the held-out fold.

    Taken in the order of a hash of the id; of several texts of one id, that of the smallest hash.  So the sample depends on neither the rows'
    order nor their partitions.  A document labelled twice takes its larger label.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded: broadcast below
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return [(r.text, r.label) for r in sorted(chosen.select("doc_id", "first.text", "label").collect(), key=lambda r: r.doc_id)]
