"""Equi-joins of two large tables that stay balanced when one key holds a
large share of the rows (used by the linkage join on hashed keys, K8).

Adaptive execution (``spark.sql.adaptive.skewJoin``, on by default) splits an
oversized partition by rows, whatever they hold, on either side of an inner join
and on the left side of the others.  What it can't split is rewritten:

* semi / anti joins: the right side is reduced to its distinct keys (combined
  map-side), so no right key is hot;
* left joins: the matching rows are an inner join, the others an anti join;
* null keys match nothing, so they pass by the join without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import col


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    keys = right.select(col(on).alias("__key")).where(F.col("__key").isNotNull())
    # Distinct over (key, hash): the join then shuffles the keys itself.  Were they dealt out by the
    # key already, an aggregation would stand under the join, and adaptive execution splits none such.
    keys = keys.withColumn("__hash", F.xxhash64("__key")).distinct().drop("__hash")
    same = col(on) == F.col("__key")
    if how == "left_semi":
        return left.join(keys, same, "left_semi")
    if how == "left_anti":
        return left.where(col(on).isNotNull()).join(keys, same, "left_anti").unionByName(left.where(col(on).isNull()))
    inner = left.join(right.withColumnRenamed(on, "__key"), same, "inner").drop("__key")
    if how == "inner":
        return inner
    return inner.unionByName(skew_join(left, right, on, "left_anti"), allowMissingColumns=True)
