"""K1 by value: one fake per value over all columns and types.

The first configured column that holds a value decides its type; the fake is that type's format at the value's place in a dense index
(``functions.formats``).  The index is the rank of ``sha2(seed || original)`` among the distinct originals of a type: distinct values are
range-partitioned by that hash and counted by partition, and a value's index is its place in its partition plus the partitions before.
No sort runs in a single task, and neither the index nor the fakes depend on how the rows are dealt.

The key table is made first and written; cells are replaced by a join with it (``lookup``), which is what one shared fake costs.  The
default of ``anonymize`` (``consistent="type"``) needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX
from veilframe.functions.fakes import DEFAULT_LOCALE, SEED, fake_hash
from veilframe.functions.formats import TAIL, fakes_of, format_of
from veilframe.functions.text import col
from veilframe.operators.pseudo import MAPPING_SCHEMA, key_text
from veilframe.session import scratch_path


def saved(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table in the shared folder: read many times, made once."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dense_index(rows: DataFrame, group: str, order: str, path: str, name: str = "idx") -> DataFrame:
    """``rows`` with each row's rank (from 0) by ``order`` among the rows of its ``group``; (group, order) is unique.

    ``rows`` is range-partitioned and written once (to ``path``), so partitions keep their rows.  The starts have one row per partition and group that it holds: at most
    the partitions plus the groups, and a caller's groups are few.
    """
    dealt = saved(rows.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()), path)
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__rows")) \
        .select(group, "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order)) - 1
    placed = dealt.withColumn("__local", local).join(F.broadcast(starts), [group, "__part"])
    return placed.withColumn(name, F.col("__start") + F.col("__local")).drop("__start", "__local", "__part")


def value_mapping(df: DataFrame, columns: list[tuple[str, str | None]], existing: DataFrame | None = None,
                  locale: str = DEFAULT_LOCALE, seed: Column | str = SEED, folder: str | None = None) -> DataFrame:
    """The key table ``(original, fake, pii_type, n)`` with one row per value; written under ``folder`` (one in the shared folder unless given), so
    reading it again runs nothing.

    ``columns``: (column, type) in the order of the configuration.  ``n`` counts the cells that hold the value.  ``existing`` (an earlier key of this
    kind, of the same seed and locale) keeps its fakes; new values continue each type's index behind its entries.
    """
    if not columns:
        empty = df.sparkSession.createDataFrame([], MAPPING_SCHEMA)
        return empty if existing is None else existing.select("original", "fake", "pii_type", "n")
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "value-key")
    types = list(dict.fromkeys(t for _c, t in columns))
    cells = [F.struct(F.lit(k).alias("_at"), key_text(col(c), df.schema[c].dataType).alias("original")) for k, (c, _t) in enumerate(columns)]
    found = df.select(F.inline(F.array(*cells))).where(F.col("original").isNotNull()) \
        .groupBy("original").agg(F.min("_at").alias("_at"), F.count(F.lit(1)).alias("n"))
    which = F.element_at(F.array(*[F.lit(types.index(t)) for _c, t in columns]), F.col("_at") + 1)
    found = found.select("original", which.alias("_t"), "n")
    known = None
    if existing is not None:
        found = saved(found, f"{folder}/values")
        known = existing.select("original", "fake", "pii_type", "n")
        fresh = found.join(known.select("original"), "original", "left_anti")
    else:
        fresh = found
    placed = dense_index(fresh.withColumn("_h", fake_hash(F.col("original"), seed)), "_t", "_h", f"{folder}/index")
    name = F.element_at(F.array(*[F.lit(t).cast("string") for t in types]), F.col("_t") + 1)
    index = F.col("idx")
    if known is not None:
        used = known.groupBy("pii_type").agg(F.count(F.lit(1)).alias("_used"))      # one row per type
        used = used.select(F.coalesce("pii_type", F.lit("")).alias("_type"), "_used")
        placed = placed.withColumn("_type", F.coalesce(name, F.lit(""))).join(F.broadcast(used), "_type", "left")
        index = index + F.coalesce("_used", F.lit(0))
    made = placed.select("original", fakes_of(types, F.col("_t"), index, locale, seed).alias("fake"), name.alias("pii_type"), "n")
    if known is not None:
        again = known.join(found.select("original", F.col("n").alias("_more")), "original", "left")
        made = again.select("original", "fake", "pii_type", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n")).unionByName(made)
    made = saved(made, f"{folder}/key")
    for part in ("values", "index"):
        drop_folder(spark, f"{folder}/{part}")
    return made


def domain_use(mapping: DataFrame, locale: str = DEFAULT_LOCALE) -> DataFrame:
    """(pii_type, entries, domain, widened) of a key by value: how much of each format is used, and the fakes beyond it."""
    known = mapping.groupBy("pii_type").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("fake").rlike(TAIL + r"\d+$").cast("bigint")).alias("widened"))
    domain = F.lit(format_of(None, locale).domain)
    for t in FX.pii_type_names():
        domain = F.when(F.col("pii_type") == t, F.lit(format_of(t, locale).domain)).otherwise(domain)
    return known.select("pii_type", "entries", domain.cast("bigint").alias("domain"), "widened")
