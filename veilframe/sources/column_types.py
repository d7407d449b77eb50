"""The type of each CSV column as the source program's reader decides it, and with it the text that a cell prints.

Every cell has the set of types it can be; a column's type is what all its cells can be, so the sets of tasks are merged by ``and`` in one
aggregation over all columns (one row comes to the driver).  Missing cells turn whole numbers into floats: ``30`` prints ``30.0``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import col

TRUTH, WHOLE, UNSIGNED, GAPPED, NUMBER, TEXT = "truth", "whole", "unsigned", "gapped", "number", "text"
BLANKS = " \t\n\x0b\x0c\r"
_WHOLE = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ENDLESS = r"^(?i)[+-]?inf(inity)?$"


def _can_be(c: Column) -> dict[str, Column]:
    cell = F.btrim(c, F.lit(BLANKS))
    digits = cell.rlike(_WHOLE)
    whole = digits & cell.try_cast("bigint").isNotNull()
    finite = cell.rlike(_NUMBER) & (F.abs(cell.try_cast("double")) < float("inf"))
    return {TRUTH: F.lower(c).isin("true", "false"), WHOLE: whole,
            UNSIGNED: digits & F.coalesce(cell.try_cast("decimal(38,0)").between(F.lit(0), F.lit(Decimal(2 ** 64 - 1))), F.lit(False)),
            NUMBER: whole | (~digits & (F.coalesce(finite, F.lit(False)) | cell.rlike(_ENDLESS)))}


def column_kinds(df: DataFrame) -> DataFrame:
    """One row per string column: ``column``, ``kind`` (truth, whole, unsigned, gapped, number or text).

    ``gapped``: whole numbers with missing cells.  A column without a value is ``number``; numbers beyond 64 bits are text, so is a
    column that mixes them with others.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, kind string")
    flags = []
    for n in names:
        every = {k: F.bool_and(F.when(col(n).isNotNull(), e)) for k, e in _can_be(col(n)).items()}
        gaps = F.count(col(n)) < F.count(F.lit(1))
        kind = F.when(F.count(col(n)) == 0, NUMBER).when(every[TRUTH], TRUTH).when(every[WHOLE], F.when(gaps, GAPPED).otherwise(WHOLE)) \
            .when(every[UNSIGNED] & ~gaps, UNSIGNED).when(every[NUMBER], NUMBER).otherwise(TEXT)
        flags.append(F.struct(F.lit(n).alias("column"), kind.alias("kind")))
    return df.agg(F.array(*flags).alias("kinds")).select(F.inline("kinds"))


def typed(df: DataFrame) -> DataFrame:
    """The string columns cast to their kind: bigint, decimal(20,0), double or string; truth values are the text ``True`` or ``False``.

    Doubles are the nearest to the cell's text.  Missing cells are null.  The kinds are taken first, in one pass over ``df``.
    """
    kinds = {r["column"]: r["kind"] for r in column_kinds(df).collect()}       # a row per column

    def cast(name: str) -> Column:
        c, cell = col(name), F.btrim(col(name), F.lit(BLANKS))
        return {TRUTH: F.initcap(c), WHOLE: cell.try_cast("bigint"), UNSIGNED: cell.try_cast("decimal(20,0)"),
                GAPPED: cell.try_cast("bigint").cast("double"), NUMBER: cell.try_cast("double")}.get(kinds.get(name), c)
    return df.select(*[cast(n).alias(n) for n in df.columns])
