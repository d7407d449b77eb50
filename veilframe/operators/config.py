"""Column configuration as small DataFrames.

A configuration has one row per column: ``column, pii_type, technique,
include``.  It is tiny (one row per column of the input table, never per
data row), so planning a projection from it on the driver is fine; the
joins below are against fixed lookup tables of at most a few dozen rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX

CONFIG_SCHEMA = "column string, pii_type string, technique string, include boolean"
DETECTION_SCHEMA = "column string, pii_type string, method string, default_tech string, include boolean"


@dataclass(frozen=True)
class ColumnRule:
    column: str
    pii_type: str | None
    technique: str
    include: bool = True


def as_rules(config) -> list[ColumnRule]:
    """Normalise a config given as DataFrame, dict or iterable to rules.

    A DataFrame config is collected: it has one row per *column*, so its
    size is bounded by the table width, not by the data.
    """
    if isinstance(config, DataFrame):
        rows = config.select("column", "pii_type", "technique", "include").collect()
        return [ColumnRule(r["column"], r["pii_type"], r["technique"],
                           True if r["include"] is None else bool(r["include"])) for r in rows]
    if isinstance(config, dict):
        out = []
        for col, spec in config.items():
            if isinstance(spec, str):
                out.append(ColumnRule(col, None, spec))
            else:
                out.append(ColumnRule(col, spec.get("pii_type"), spec["technique"],
                                      spec.get("include", True)))
        return out
    out = []
    for item in config:
        if isinstance(item, ColumnRule):
            out.append(item)
        else:
            out.append(ColumnRule(*item))
    return out


def config_df(spark: SparkSession, rules: Iterable[ColumnRule]) -> DataFrame:
    return spark.createDataFrame([(r.column, r.pii_type, r.technique, r.include) for r in rules],
                                 CONFIG_SCHEMA)


def add_manual(detected: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual columns ``(column, pii_type)`` overwrite any detection.

    Manual rows get method 'manual', default technique Masking, include True.
    """
    spark = detected.sparkSession
    m = manual.select(
        "column", "pii_type",
        F.lit("manual").alias("method"),
        F.lit(FX.FALLBACK_TECHNIQUE).alias("default_tech"),
        F.lit(True).alias("include"))
    kept = detected.join(m.select("column"), "column", "left_anti")
    return kept.unionByName(m)


def apply_overrides(detected: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides ``(column, pii_type, include)``.

    ``include`` (when not null) replaces the flag; ``pii_type`` replaces the
    type unless null, '' or '(none)'.  ``default_tech`` is *not* recomputed,
    so it keeps the default of the previously detected type.
    """
    o = overrides.select(F.col("column"), F.col("pii_type").alias("_o_type"),
                         F.col("include").alias("_o_inc"))
    j = detected.join(o, "column", "left")
    new_type = F.when(F.col("_o_type").isNull() | F.col("_o_type").isin("", FX.OVERRIDE_NONE),
                      F.col("pii_type")).otherwise(F.col("_o_type"))
    return j.select("column", new_type.alias("pii_type"), "method", "default_tech",
                    F.coalesce("_o_inc", "include").alias("include"))


def included(detected: DataFrame) -> DataFrame:
    """Excluded columns get no technique."""
    return detected.filter(F.col("include"))


def technique_for(spark: SparkSession, detected: DataFrame, profile: str | None) -> DataFrame:
    """Technique per included column from a profile.

    profile technique -> the type's default technique -> Masking.
    """
    rules = spark.createDataFrame([(r[1], r[4]) for r in FX.PII_RULES],
                                  "pii_type string, _rule_default string")
    prof = FX.profiles_df(spark).filter(F.col("profile") == F.lit(profile)) \
        .select("pii_type", F.col("technique").alias("_prof_tech"), "priority")
    # both lookups are fixed tables of at most ten rows
    j = (included(detected)
         .join(F.broadcast(prof), "pii_type", "left")
         .join(F.broadcast(rules), "pii_type", "left"))
    return j.select(
        "column", "pii_type",
        F.coalesce("_prof_tech", "_rule_default", F.lit(FX.FALLBACK_TECHNIQUE)).alias("technique"),
        F.lit(True).alias("include"),
        F.coalesce("priority", F.lit(False)).alias("priority"))


def build_config(detected: DataFrame, chosen: DataFrame | None = None,
                 require_non_empty: bool = True) -> DataFrame:
    """technique = the chosen one (e.g. from a profile), else default_tech.

    Excluded columns are dropped.  An empty config is rejected, as the
    processing step refuses to run without one.
    """
    base = included(detected)
    if chosen is not None:
        c = chosen.select("column", F.col("technique").alias("_chosen"))
        base = base.join(c, "column", "left")
        tech = F.coalesce("_chosen", "default_tech")
    else:
        tech = F.col("default_tech")
    out = base.select("column", "pii_type", tech.alias("technique"), F.lit(True).alias("include"))
    if require_non_empty and out.isEmpty():
        raise ValueError("no columns selected for processing")
    return out


def resolve(detected: DataFrame, profile: str | None = None, chosen: dict[str, str] | None = None) -> DataFrame:
    """The config for a detection table and a profile.

    ``chosen`` (column -> technique) keeps what was chosen before: it wins over profile and default.

    The detection table has one row per column (``detect`` returns it
    materialised), so it is resolved over its collected rows against the
    fixed profile table: no Spark job per lookup.  ``technique_for`` and
    ``build_config`` are the same steps as DataFrame joins.
    """
    spark = detected.sparkSession
    prof = FX.get_profile(profile) if profile is not None else None
    rows = []
    for r in detected.select("column", "pii_type", "default_tech", "include").collect():
        if r["include"] is False:
            continue
        if profile is not None:
            # Profile technique -> the type's default -> Masking
            tech = (prof[2].get(r["pii_type"]) if prof else None) or FX.default_technique(r["pii_type"])
        else:
            # C5 without a profile: the detection's default technique
            tech = r["default_tech"] or FX.FALLBACK_TECHNIQUE
        tech = (chosen or {}).get(r["column"], tech)
        rows.append((r["column"], r["pii_type"], tech, True))
    if not rows:
        raise ValueError("no columns selected for processing")
    return spark.createDataFrame(rows, CONFIG_SCHEMA)
