"""Replacement of cell values through a key -> value table (restore: fake -> original).

The table can be as large as the data's distinct values.  It is broadcast only
when its measured text is below ``broadcast_bytes``; otherwise each column is a
left join.  The table has one row per key, so a hot or null key only makes the
*data* side of a partition large, and adaptive execution splits that side
(``spark.sql.adaptive.skewJoin``): no salt, and no key is treated apart.

A bucketed table isn't shuffled, so adaptive execution can't split its joins.  There the most frequent keys of the data, found by one
mergeable sketch and bounded in number, take their values from a broadcast of their own rows, and they and null keys are spread over all
partitions.  The sketch decides where a row is joined, never what it gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS, TRACKED = 10_000, 100_000      # a key beyond the first 10,000 holds less than a 10,000th of the rows


def measured_bytes(table: DataFrame, key: str, value: str) -> int:
    """Text of the table's two columns and a row's overhead (one aggregation)."""
    return int(table.agg(F.sum(F.octet_length(key) + F.octet_length(value) + 48)).first()[0] or 0)


def hot_keys(df: DataFrame, keys: list[str]) -> list[list[str]]:
    """Per key column the values that hold at least a ``HOT_KEYS``-th of the rows: at most so many, whatever the table's size."""
    tops = [F.expr(f"approx_top_k({k}, {HOT_KEYS}, {TRACKED})").alias(k) for k in keys]
    found = df.agg(F.count(F.lit(1)).alias("__rows"), *tops).first()
    return [[t["item"] for t in found[k] or [] if t["item"] is not None and t["count"] * HOT_KEYS >= found["__rows"]] for k in keys]


def replace_values(df: DataFrame, keys: dict[str, Column], table: DataFrame, key: str, value: str,
                   broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, bucketed: bool = False) -> DataFrame:
    """For each ``column -> key expression`` in ``keys``: the ``value`` of the
    table row whose ``key`` equals the cell's key (null key = blank cell).

    Returns ``df`` plus one column ``__lk_<column>`` per entry holding the
    looked-up value (null when unmatched); callers decide how to merge.
    ``bucketed``: the table's scan is bucketed by its key, so its side isn't shuffled.
    """
    small = measured_bytes(table, key, value) <= broadcast_bytes
    names = list(keys)
    out = df.withColumns({f"__k{i}": keys[name] for i, name in enumerate(names)})
    hot = hot_keys(out, [f"__k{i}" for i in range(len(names))]) if bucketed and not small else []
    for i, name in enumerate(names):
        side = table.select(F.col(key).alias(f"__tk{i}"), F.col(value).alias(f"__lk_{name}"))
        if not hot:
            out = out.join(F.broadcast(side) if small else side, F.col(f"__k{i}") == F.col(f"__tk{i}"), "left")
            continue
        known = df.sparkSession.createDataFrame([(k,) for k in hot[i]], f"__hk{i} string")
        known = known.join(side.where(F.col(f"__tk{i}").isin(hot[i])), F.col(f"__hk{i}") == F.col(f"__tk{i}"), "left") \
            .select(f"__hk{i}", F.col(f"__lk_{name}").alias(f"__hv{i}"))
        out = out.join(F.broadcast(known), F.col(f"__k{i}") == F.col(f"__hk{i}"), "left")      # at most HOT_KEYS rows
        apart = F.col(f"__k{i}").isNull() | F.col(f"__hk{i}").isNotNull()
        # text that no key is: a NUL and the number of the row's task, the same when a task is run again
        out = out.withColumn(f"__j{i}", F.when(apart, F.concat(F.lit("\0"), F.spark_partition_id().cast("string"))).otherwise(F.col(f"__k{i}")))
        out = out.join(side, F.col(f"__j{i}") == F.col(f"__tk{i}"), "left") \
            .withColumn(f"__lk_{name}", F.coalesce(f"__hv{i}", f"__lk_{name}")).drop(f"__hk{i}", f"__hv{i}", f"__j{i}")
    return out.drop(*[f"__{x}{i}" for i in range(len(names)) for x in ("k", "tk")])
