"""Table sources and sinks.

CSV is read with an all-string schema by default (inference would turn
``0300...`` into a number and lose the zeros), so values reach the
techniques as the text that was in the file.  Parquet is the scale format.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import col
from veilframe.sources import column_types, csv_records

# --- fixed values: text pandas' CSV reader turns into missing values ----------
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
RUN_STAMP_FORMAT = "%Y%m%d_%H%M%S"

CSV_READ_OPTIONS = {"header": "true", "escape": '"', "quote": '"',
                    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_WRITE_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "emptyValue": "",
                     "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, infer_types: bool = False,
             multiline: bool = False, na_tokens: bool = True, types: str | None = None) -> DataFrame:
    """Header row, comma separated; all columns string unless ``infer_types`` (Spark's inference) or
    ``types="pandas"`` (``column_types``, a pass of its own).  ``multiline`` allows newlines inside quotes: files are split all
    the same (``csv_records``, a pass of its own), but with ``infer_types`` a file is one task."""
    if types not in (None, "pandas"):
        raise ValueError(f"types is None or 'pandas', not {types!r}")
    if multiline and not infer_types:
        df = csv_records.read_records(spark, path, CSV_READ_OPTIONS)
    else:
        df = spark.read.options(**CSV_READ_OPTIONS, multiLine=str(multiline).lower(), inferSchema=str(infer_types).lower()).csv(path)
    df = with_na_tokens(df) if na_tokens else df
    return column_types.typed(df) if types else df


def with_na_tokens(df: DataFrame, tokens: list[str] = NA_TOKENS) -> DataFrame:
    """String cells equal to an NA token become null."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(col(f.name).isin(*tokens), F.lit(None).cast("string")).otherwise(col(f.name))
    return df.select(*[out.get(c, col(c)).alias(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """All columns, header, whitespace kept, empty strings as ``""``-free empties."""
    df.write.mode(mode).options(**CSV_WRITE_OPTIONS).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def run_stamp(now: datetime | None = None) -> str:
    """``YYYYMMDD_HHMMSS`` shared by the outputs of one run."""
    return (now or datetime.now()).strftime(RUN_STAMP_FORMAT)


def write_audit(tables: dict[str, DataFrame], path: str) -> str:
    """Each audit table (all tiny) as one JSON-lines file under ``path``."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
    return path
