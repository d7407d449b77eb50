"""K1-K8: consistent pseudonyms, key table, restore, integrity, linkage.

A fake is a pure function of the column's type and the stripped text
(``functions.fakes``), so replacing values is row-local: any number of Fake Data
columns, batch or stream, needs no join, shuffle or state.  One value has one
fake per type, wherever it stands.  The key table (original -> fake) is a
distinct aggregation over the same columns; it is built only when a key is
written or a restore is wanted.
"""

from __future__ import annotations

from datetime import datetime
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import fixed as FX
from veilframe.functions.fakes import DEFAULT_LOCALE, SEED, fake_value
from veilframe.functions.text import as_text, col, is_blank, py_strip
from veilframe.operators import key_store, lookup, privacy
from veilframe.operators.joins import skew_join
from veilframe.operators.key_store import merged, read_key  # noqa: F401

MAPPING_SCHEMA = "original string, fake string, pii_type string, n bigint"


def key_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """Mapping key of a cell: stripped text, null for blank cells."""
    v = as_text(c, dtype)
    return F.when(is_blank(v), F.lit(None).cast("string")).otherwise(py_strip(v))


def fake_column(c: Column, pii_type: str | None, dtype: T.DataType | None = None,
                locale: str = DEFAULT_LOCALE, seed: Column | str = SEED) -> Column:
    """K1: blank cells unchanged, other cells replaced by their fake."""
    key = key_text(c, dtype)
    return F.when(key.isNull(), as_text(c, dtype)).otherwise(fake_value(pii_type, key, locale, seed))


def build_mapping(df: DataFrame, columns: list[tuple[str, str | None]], existing: DataFrame | None = None,
                  locale: str = DEFAULT_LOCALE, seed: Column | str = SEED) -> DataFrame:
    """K1/K2/K4: the key table ``(original, fake, pii_type, n)``, ``n`` = cells that hold the original.

    One scan unpivots the columns; ``groupBy(original, type)`` combines map-side, so
    a value that fills a third of the table is one row per task before the shuffle,
    and fakes are made per distinct value.  ``existing`` (an earlier key) is
    kept and extended.
    """
    if not columns:
        empty = df.sparkSession.createDataFrame([], MAPPING_SCHEMA)
        return empty if existing is None else merged(existing.select("original", "fake", "pii_type", "n"))
    types = list(dict.fromkeys(t for _c, t in columns))
    cells = [F.struct(F.lit(types.index(t)).alias("_t"), key_text(col(c), df.schema[c].dataType).alias("original"))
             for c, t in columns]
    cells = df.select(F.inline(F.array(*cells))).where(F.col("original").isNotNull())
    found = cells.groupBy("_t", "original").agg(F.count(F.lit(1)).alias("n"))
    fake = name = None
    for i, t in enumerate(types):
        is_t, f, n = F.col("_t") == i, fake_value(t, F.col("original"), locale, seed), F.lit(t).cast("string")
        fake, name = (F.when(is_t, f), F.when(is_t, n)) if fake is None else (fake.when(is_t, f), name.when(is_t, n))
    fresh = found.select("original", fake.alias("fake"), name.alias("pii_type"), "n")
    if existing is None:
        return fresh
    return merged(existing.select("original", "fake", "pii_type", "n").unionByName(fresh))


def pseudonymize(df: DataFrame, columns: list[tuple[str, str | None]], existing: DataFrame | None = None,
                 **fake_args) -> tuple[DataFrame, DataFrame]:
    out = df.withColumns({c: fake_column(col(c), t, df.schema[c].dataType, **fake_args) for c, t in columns})
    return out, build_mapping(df, columns, existing, **fake_args)


def restore(df: DataFrame, mapping: DataFrame, columns: list[str], **lookup_args) -> DataFrame:
    """K6: fake -> original; values with no mapping are kept."""
    present = [c for c in columns if c in df.columns]
    keys = {c: as_text(col(c), df.schema[c].dataType) for c in present}
    j = lookup.replace_values(df, keys, mapping, "fake", "original", **lookup_args)
    out_cols = [F.coalesce(col(f"__lk_{c}"), keys[c]).alias(c) if c in keys else col(c)
                for c in df.columns]
    return j.select(*out_cols)


def restore_from(df: DataFrame, path: str, columns: list[str], secret: Column | None = None, **lookup_args) -> DataFrame:
    """K6 from a key on disk.  Of a compacted key (``key_store.compact_key``) the buckets are joined as they lie: only the data is shuffled."""
    return restore(df, read_key(df.sparkSession, path, secret), columns, bucketed=True, **lookup_args)


def collisions(mapping: DataFrame) -> DataFrame:
    """K7: fakes shared by more than one original (must be empty)."""
    return mapping.groupBy("fake").agg(F.countDistinct("original").alias("originals")) \
        .filter(F.col("originals") > 1)


def hash_link(left: DataFrame, left_key: str, right: DataFrame, right_key: str,
              how: str = "inner", salt: Column | str | None = None) -> DataFrame:
    """K8: link two tables on SHA-256 of their keys (P5 on both sides).

    ``joins.skew_join`` keeps a key that holds a large share of either side
    out of a single task."""
    def h(df, c):
        v = as_text(col(c), df.schema[c].dataType)
        payload = v if salt is None else F.concat(F.lit(salt) if isinstance(salt, str) else salt, v)
        return F.when(is_blank(v), F.lit(None).cast("string")).otherwise(F.sha2(payload, 256))
    lh = left.withColumn("link_hash", h(left, left_key)).drop(left_key)
    rh = right.withColumn("link_hash", h(right, right_key)).drop(right_key)
    return skew_join(lh, rh, "link_hash", how)


# ---------------------------------------------------------------------------
# The key as tables
# ---------------------------------------------------------------------------

def key_metadata(mapping: DataFrame, source_file: str, configured_cols: list[str],
                 fake_cols: list[str], generated_at: datetime | None = None) -> DataFrame:
    """One-row metadata table of a key export."""
    ts = generated_at or datetime.now()
    meta = mapping.agg(F.count(F.lit(1)).alias("total_mappings"))
    return meta.select(
        # text parsed in the session time zone: renders back to the same wall time
        F.lit(ts.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp").alias("generated_at"),
        F.lit(os.path.basename(source_file)).alias("source_file"),
        F.array(*[F.lit(c) for c in configured_cols]).cast("array<string>").alias("pseudonymized_cols"),
        F.array(*[F.lit(c) for c in fake_cols]).cast("array<string>").alias("fake_cols"),
        F.col("total_mappings").cast("bigint"),
        F.lit(FX.KEY_TOOL).alias("tool"),
        F.lit("key table: store separately from the data; it reverses the pseudonyms").alias("warning"))


def write_key(mapping: DataFrame, path: str, source_file: str = "", configured_cols: list[str] | None = None,
              fake_cols: list[str] | None = None, generated_at: datetime | None = None,
              secret: Column | None = None) -> DataFrame:
    """Write the mapping and its metadata under ``path`` (separate from the data); returns the written mapping.

    ``secret`` (``privacy.secret_column``) encrypts the originals.  The metadata counts
    the written rows, so the mapping is built once.
    """
    rows = mapping.select("original", "fake", "pii_type", "n")
    rows = rows if secret is None else privacy.encrypt_key(rows, secret)
    key_store.drop_versions(rows.sparkSession, path)
    rows.write.mode("overwrite").parquet(f"{path}/mapping")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/mapping")
    meta = key_metadata(written, source_file, configured_cols or [], fake_cols or [], generated_at)
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return written
