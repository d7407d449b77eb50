"""A1-A5: audit tables of a run (summary, per-column actions, compliance
matrix, change counts).  The report is data, not text: three DataFrames
that can be written next to the output (sink S7)."""

from __future__ import annotations

from datetime import datetime
import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX
from veilframe.functions.text import as_text, col, is_blank, sql_string
from veilframe.operators.config import as_rules
from veilframe.operators.transform import Anonymized, anonymize

PROCESSED, SKIPPED = "PROCESSED", "SKIPPED"


IRREVERSIBLE_NOTE = "No key was kept: the values that this run replaced cannot be brought back."
REVERSIBLE_NOTE = "A key was kept: whoever holds it can bring the replaced values back, so store it away from the data."


def mode_note(mode: str) -> str:
    """A4: what the mode means for a reader of the audit."""
    return REVERSIBLE_NOTE if reversible(mode) else IRREVERSIBLE_NOTE


def reversible(mode: str) -> bool:
    """A4: whether a key is written that undoes the run's pseudonyms."""
    return mode == FX.MODE_PSEUDONYMIZATION


def audit_summary(rows: DataFrame, run_id: str, input_file: str, output_file: str, mode: str,
                  profile: str | None, config, key_file: str | None = None,
                  run_at: datetime | None = None) -> DataFrame:
    """A1/A4: one row.  ``rows`` is the processed table (counted here, one
    aggregation) or a one-row DataFrame with a ``rows`` column."""
    rules = as_rules(config)
    modified = sum(1 for r in rules if r.include)
    counted = rows if rows.columns == ["rows"] else rows.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(
        F.lit(run_id).alias("run_id"),
        F.lit((run_at or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp").alias("run_at"),
        F.lit(os.path.basename(input_file)).alias("input"),
        F.lit(os.path.basename(output_file)).alias("output"),
        F.lit(mode).alias("mode"),
        F.lit(profile).cast("string").alias("profile"),
        F.col("rows").cast("bigint").alias("rows"),
        F.lit(len(rules)).cast("bigint").alias("cols_analysed"),
        F.lit(modified).cast("bigint").alias("cols_modified"),
        F.lit(len(rules) - modified).cast("bigint").alias("cols_skipped"),
        F.lit(os.path.basename(key_file) if key_file else None).cast("string").alias("key"),
        F.lit(reversible(mode)).alias("reversible"),
        F.lit(mode_note(mode)).alias("note"))


def audit_columns(spark: SparkSession, run_id: str, config) -> DataFrame:
    """A2: processed columns first, then skipped ones (type/technique blank)."""
    rules = as_rules(config)
    rows = [(run_id, r.column, r.pii_type, r.technique, PROCESSED) for r in rules if r.include]
    rows += [(run_id, r.column, None, None, SKIPPED) for r in rules if not r.include]
    return spark.createDataFrame(
        rows, "run_id string, column string, pii_type string, technique string, status string")


def compliance_matrix(spark: SparkSession, config) -> DataFrame:
    """A3: distinct techniques used, each joined to its provisions; a
    technique with no entry gets a single 'none' line."""
    used = sorted({r.technique for r in as_rules(config) if r.include})
    techs = spark.createDataFrame([(t,) for t in used], "technique string")
    lookup = FX.compliance_df(spark)
    # both sides are fixed, tiny tables (six techniques x five frameworks)
    j = techs.join(F.broadcast(lookup), "technique", "left")
    return j.select(
        "technique",
        F.coalesce("framework", F.lit(FX.NO_COMPLIANCE_FRAMEWORK)).alias("framework"),
        F.coalesce("seq", F.lit(1)).alias("seq"),
        F.coalesce("provision", F.lit(FX.NO_COMPLIANCE_PROVISION)).alias("provision"),
    ).orderBy("technique", "framework", "seq")


COUNTS = "column string, rows bigint, unchanged bigint, changed bigint, blank bigint"


def _measured(df: DataFrame, config, **kw) -> tuple[Anonymized, list[Column]]:
    """A run over ``df`` that carries the configured cells' texts beside them, and per applied column its counts of unchanged and blank cells.

    Before and after are two expressions of one projection: one scan and one
    aggregation, no join."""
    rules = [r for r in as_rules(config) if r.include and r.column in df.columns]
    carried = df.select(*[col(c) for c in df.columns],
                        *[as_text(col(r.column), df.schema[r.column].dataType).alias(f"__b_{i}") for i, r in enumerate(rules)])
    res = anonymize(carried, rules, **kw)
    place = {r.column: i for i, r in enumerate(rules)}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, r in enumerate(res.applied):
        b, a = F.col(f"__b_{place[r.column]}"), col(r.column)
        aggs += [F.count(F.when(b.eqNullSafe(a), 1)).alias(f"u_{i}"),
                 F.count(F.when(is_blank(b), 1)).alias(f"b_{i}")]
    return res, aggs


def change_counts(df: DataFrame, config, **kw) -> DataFrame:
    """A5: per configured column, rows unchanged / changed / blank before."""
    res, aggs = _measured(df, config, **kw)
    if not res.applied:
        return df.sparkSession.createDataFrame([], COUNTS)
    wide = res.df.agg(*aggs)
    stack = ", ".join(f"{sql_string(r.column)}, u_{i}, b_{i}" for i, r in enumerate(res.applied))
    long = wide.select("rows", F.expr(f"stack({len(res.applied)}, {stack}) AS (column, unchanged, blank)"))
    return long.select("column", F.col("rows").cast("bigint"), F.col("unchanged").cast("bigint"),
                       (F.col("rows") - F.col("unchanged")).cast("bigint").alias("changed"),
                       F.col("blank").cast("bigint"))


def observed(df: DataFrame, config, seen: Observation, **kw) -> Anonymized:
    """A run whose counts (S3, A5) are taken by ``seen`` while its rows are written: no pass of its own."""
    res, aggs = _measured(df, config, **kw)
    res.df = res.df.observe(seen, *aggs).select(*[col(c) for c in df.columns])
    return res


def observed_counts(spark: SparkSession, seen: Observation, res: Anonymized) -> DataFrame:
    """What ``seen`` took, as rows like ``change_counts``'s; the row whose column is null has the number of rows alone."""
    got = seen.get
    rows = [(None, got["rows"], None, None, None)]
    rows += [(r.column, got["rows"], got[f"u_{i}"], got["rows"] - got[f"u_{i}"], got[f"b_{i}"]) for i, r in enumerate(res.applied)]
    return spark.createDataFrame(rows, COUNTS)
