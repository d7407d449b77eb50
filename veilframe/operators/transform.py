"""Apply a column configuration to a table.

One ``withColumns`` of native expressions for every technique, Fake Data
included (whole-stage codegen, no Python, no shuffle).  Output schema: same columns in
the same order; configured columns become strings, the others keep their type.
"""

from __future__ import annotations

from dataclasses import dataclass, field
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import fixed as FX
from veilframe.functions.fakes import DEFAULT_LOCALE, SEED
from veilframe.functions.techniques import technique_column
from veilframe.functions.text import as_text, col
from veilframe.operators import lookup, pseudo, value_key
from veilframe.operators.config import ColumnRule, as_rules
from veilframe.session import scratch_path, spread
from veilframe.sources import file_order


@dataclass
class Anonymized:
    df: DataFrame
    source: DataFrame
    applied: list[ColumnRule] = field(default_factory=list)     # columns changed
    skipped: list[ColumnRule] = field(default_factory=list)     # unknown technique / missing
    existing: DataFrame | None = None
    fake_args: dict = field(default_factory=dict)
    value_key: DataFrame | None = None      # the written key where one fake serves all types
    key_folder: str | None = None

    @property
    def fake_columns(self) -> list[str]:
        return [r.column for r in self.applied if r.technique == FX.FAKE_DATA]

    @property
    def mapping(self) -> DataFrame:
        """K3: the key table of the Fake Data columns, from the input; nothing is computed before it is read."""
        if self.value_key is not None:
            return self.value_key
        return pseudo.build_mapping(self.source, [(r.column, r.pii_type) for r in self.applied if r.technique == FX.FAKE_DATA],
                                    self.existing, **self.fake_args)


def anonymize(df: DataFrame, config, mode: str = FX.MODE_ANONYMIZATION,
              existing_mapping: DataFrame | None = None, unicode: bool = False,
              salt: Column | str | None = None, spread_input: bool = True,
              locale: str = DEFAULT_LOCALE, seed: Column | str = SEED, consistent: str = "type") -> Anonymized:
    """Every included, present column gets its technique.

    ``consistent``: a value has one fake per type, a function of the value alone ("type"), or one fake in all Fake Data columns, in the
    format of the first configured one that holds it ("value": the key is made and written first, and cells are joined with it).

    ``mode`` changes no value (it only gates the key export, K5).  Columns
    missing from ``df`` are skipped; unknown techniques warn and keep the
    column unchanged (P13).
    """
    if consistent not in ("type", "value"):
        raise ValueError(f"consistent is 'type' or 'value', not {consistent!r}")
    rules = [r for r in as_rules(config) if r.include]
    if spread_input:
        df = spread(df)      # no-op unless a small input sits in fewer files than task slots
    fake_args = {"locale": locale, "seed": seed}
    # a float's text is long to work out and the techniques use it several times: a projection of its own
    floats = {f.name: as_text(col(f.name), f.dataType) for f in df.schema.fields
              if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and any(r.column == f.name and r.technique in FX.TECHNIQUE_NAMES for r in rules)}
    texts = df.select(*[floats[c].alias(c) if c in floats else col(c) for c in df.columns]) if floats else df
    exprs, applied, skipped, shared = {}, [], [], []
    for r in rules:
        if r.column not in df.columns:
            skipped.append(r)
            continue
        dtype = texts.schema[r.column].dataType
        if r.technique == FX.FAKE_DATA and consistent == "value":
            shared.append((r.column, r.pii_type))
            e = F.coalesce(col(f"__lk_{r.column}"), as_text(col(r.column), dtype))     # blank cells have no entry
        elif r.technique == FX.FAKE_DATA:
            e = pseudo.fake_column(col(r.column), r.pii_type, dtype, **fake_args)
        else:
            e = technique_column(col(r.column), r.technique, r.pii_type, dtype, unicode=unicode, salt=salt)
        if e is None:
            warnings.warn(f"unknown technique {r.technique!r} for column {r.column!r}; unchanged")
            skipped.append(r)
            continue
        exprs[r.column] = e
        applied.append(r)
    key = folder = None
    if shared:
        folder = scratch_path(df.sparkSession, "value-key")
        key = value_key.value_mapping(df, shared, existing_mapping, **fake_args, folder=folder)
        texts = lookup.replace_values(texts, {c: pseudo.key_text(col(c), texts.schema[c].dataType) for c, _t in shared}, key, "original", "fake")
    out = texts.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns]) if exprs else df
    return Anonymized(out, df, applied, skipped, existing_mapping, fake_args, key, folder)


def preview(df: DataFrame, config, key: str | None = None, n: int = FX.PREVIEW_ROWS, **kw) -> DataFrame:
    """The first ``n`` rows by ``key``, or in file order without one, before and after.

    The limit is the feature here (a preview); it is applied before the
    transform, so only ``n`` rows are ever transformed.  Output: ``key`` (without one: ``row``, the row's number from 1),
    then for each changed column ``<col>_before`` and ``<col>_after``.
    """
    rules = [r for r in as_rules(config) if r.include and r.column in df.columns]
    shown = key or "row"
    if key is None:
        key = file_order.fresh_name(df, "__row")
        head = file_order.first_rows(df, n, key)
    else:
        head = df.orderBy(col(key)).limit(n)
    head = head.select("*", *[col(r.column).cast("string").alias(f"__before_{r.column}")
                              for r in rules])
    res = anonymize(head, rules, spread_input=False, **kw)
    cols = [col(key).alias(shown)]
    for r in res.applied:
        cols += [col(f"__before_{r.column}").alias(f"{r.column}_before"),
                 col(r.column).alias(f"{r.column}_after")]
    return res.df.select(*cols)


def config_errors(df: DataFrame, config) -> DataFrame:
    """P15's error report: one row per configured column that cannot be
    applied (missing from the table, or an unknown technique).  Native
    expressions do not fail per cell, so this check replaces the per-column
    ``[ERROR: ...]`` of a row-by-row preview; its row count is the error count."""
    rows = []
    for r in as_rules(config):
        if not r.include:
            continue
        if r.column not in df.columns:
            rows.append((r.column, r.technique, "column not in table"))
        elif r.technique not in FX.TECHNIQUE_NAMES:
            rows.append((r.column, r.technique, "unknown technique"))
    return df.sparkSession.createDataFrame(rows, "column string, technique string, problem string")
