"""Documented wishes built as extensions (flagged as such).

X1 salted hash is ``hash_sha256(v, salt=...)`` / ``anonymize(..., salt=...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.techniques import age_band
from veilframe.functions.text import as_text, col
from veilframe.operators.joins import skew_join

TOP_CODE_AGE = 90


def k_anonymity(df: DataFrame, quasi_identifiers: list[str]) -> DataFrame:
    """Equivalence classes over the quasi-identifiers with their size ``k``.

    A plain ``groupBy`` (partial aggregation before the shuffle, so a class
    holding a third of the table is combined map-side)."""
    return df.groupBy(*[col(c) for c in quasi_identifiers]).agg(F.count(F.lit(1)).alias("k"))


def k_anonymity_summary(df: DataFrame, quasi_identifiers: list[str], k_min: int) -> DataFrame:
    """Table-level k (smallest class), class count and rows in classes below ``k_min``."""
    classes = k_anonymity(df, quasi_identifiers)
    return classes.agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("classes"),
                       F.sum(F.when(F.col("k") < k_min, F.col("k")).otherwise(0)).cast("bigint")
                       .alias("rows_below_k"))


def k_histogram(df: DataFrame, quasi_identifiers: list[str]) -> DataFrame:
    """How many classes, and rows in them, have each size ``k``."""
    return k_anonymity(df, quasi_identifiers).groupBy("k").agg(F.count(F.lit(1)).alias("classes"), (F.col("k") * F.count(F.lit(1))).alias("rows"))


def rows_below_k(df: DataFrame, quasi_identifiers: list[str], k_min: int) -> DataFrame:
    """The rows whose class is smaller than ``k_min``, with the class size ``k``.

    Class sizes come from a partially aggregated ``groupBy``; the rows are
    then joined to the small classes, so a class holding a third of the table
    (never small) is not buffered in one task.  The class key is the JSON of the
    quasi-identifier tuple: a null-safe, single-column encoding."""
    key = F.to_json(F.struct(*[col(c) for c in quasi_identifiers]))
    keyed = df.withColumn("__qi", key)
    small = keyed.groupBy("__qi").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") < k_min)
    return skew_join(keyed, small, "__qi", "inner").drop("__qi")


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """X3."""
    return df.drop(*columns)


def age_top_coded(c: Column, dtype=None, top: int = TOP_CODE_AGE) -> Column:
    """Decade band, with ``top``+ for ages at or above ``top``."""
    v = as_text(c, dtype)
    band = age_band(v)
    num = v.try_cast("double")
    return F.when(v.isNull(), v).when(num >= top, F.lit(f"{top}+")).otherwise(band)


def secret_column(spark: SparkSession, path: str) -> Column:
    """The first line of a file as a scalar subquery: the plan, explain and event log name the file, not the secret."""
    return spark.read.text(path, wholetext=False).limit(1).select("value").scalar()


def encrypt_key(mapping: DataFrame, secret: Column, column: str = "original") -> DataFrame:
    """The mapping with ``column`` AES-GCM encrypted (base64 text)."""
    return mapping.withColumn(column, F.base64(F.aes_encrypt(F.col(column), secret)))


def decrypt_key(mapping: DataFrame, secret: Column, column: str = "original") -> DataFrame:
    return mapping.withColumn(column, F.aes_decrypt(F.unbase64(F.col(column)), secret).cast("string"))
