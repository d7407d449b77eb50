"""Contiguous shards of near equal size from global byte-size prefix sums.

Rows are range-partitioned by doc_id.  Each partition's total is one row; the running sum of those totals, as long as the list
of partitions, gives every partition its start, and a sum inside the partition does the rest.  A row's shard is
the one of ``shards`` equal stretches of the total in which its middle byte lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.base import Tables

OVERHEAD = 8


def balanced_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of ``docs`` (doc_id, text; other columns are not read).

    ``size``: UTF-8 bytes of the text (null: none) plus 8.  Shards are contiguous in the order of (doc_id with nulls first,
    text_crc32, size); equal rows in any order.  A shard's bytes differ from total / shards by at most one row's size.
    ``slot`` is gapless from 0 in each shard.  An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "shards")
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    order = ["doc_id", "text_crc32", "size", "tie"]
    rows = docs.select(F.col("doc_id").cast("long"), F.crc32(data).alias("text_crc32"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"))
    # the tie spreads equal rows (or a third without doc_id) over partitions
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    dealt = tables.save(rows.withColumn("part", F.spark_partition_id()), "dealt")

    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("from_byte"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("from_row"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    own = Window.partitionBy("part").orderBy(*order)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("byte", F.coalesce(F.sum("size").over(earlier), F.lit(0))).withColumn("row", F.row_number().over(own) - 1)
    placed = placed.join(F.broadcast(starts), "part")
    shard = F.expr(f"({shards} * (2 * (from_byte + byte) + size)) div (2 * total)").cast("int")
    placed = tables.save(placed.select("doc_id", "size", "text_crc32", F.least(shard, F.lit(shards - 1)).alias("shard"), (F.col("from_row") + F.col("row")).alias("at")), "placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    out = placed.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
