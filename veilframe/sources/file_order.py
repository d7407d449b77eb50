"""Rows in the order of their files, for tables read from files and used without a key.

A row's place is its file's path, then its number in the file (parquet), or its split's start and its number in the task (other formats;
a task reads the rows of a split in order).  The place comes with the scan, so first rows need no shuffle of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.text import col
from veilframe.session import is_file_scan


MOST_NAMED = 1024


def _metadata(df: DataFrame) -> Column:
    if not is_file_scan(df):
        raise ValueError("without a key, rows must come straight from files: only projections and filters over one scan have an order")
    return df.metadataColumn("_metadata")


def fresh_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def placed(df: DataFrame, name: str) -> DataFrame:
    """``df`` and a column ``name`` whose order is that of the rows in their files."""
    meta = _metadata(df)
    fields = df.select(meta.alias("m")).schema["m"].dataType.names
    if "row_index" in fields:
        start, row = F.lit(0), meta["row_index"]
    else:
        start, row = meta["file_block_start"], F.monotonically_increasing_id()
    return df.select(*[col(c) for c in df.columns], F.struct(meta["file_path"].alias("file"), start.alias("start"), row.alias("row")).alias(name))


def prefixes(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` over its first 1, 4, 16, ... files in order of their paths, up to 1,024, then over all.

    The paths are those that the driver's file index holds.  A filter on the file's path keeps the scan to the files of a prefix; it names
    them as rows have them (escaped) and as the listing is filtered by (unescaped).  Where a name has a percent sign of its own
    the two could be mixed up, and all files are read."""
    path = _metadata(df)["file_path"]
    names, many = sorted(df.inputFiles()), 1
    jvm = df.sparkSession._jvm
    while many < min(len(names), MOST_NAMED + 1) and not any("%25" in n for n in names):
        plain = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(n)).toString() for n in names[:many]}
        escaped = {jvm.org.apache.hadoop.fs.Path(p).toUri().toString() for p in plain}
        yield df.where(path.isin(sorted(plain | escaped)))
        many *= 4
    yield df


def first_rows(df: DataFrame, n: int, name: str) -> DataFrame:
    """The first ``n`` rows in file order and their numbers from 1 as column ``name``; files after those that hold them aren't read."""
    place = fresh_name(df, "__place")
    for part in prefixes(df):
        if part.limit(n).count() >= n:
            break
    head = placed(part, place).orderBy(place).limit(n)
    return head.withColumn(name, F.row_number().over(Window.orderBy(place)).cast("bigint")).drop(place)      # n rows in one task


def first_parts(df: DataFrame, columns: list[str], present: dict[str, Column], n: int) -> list[tuple[list[str], DataFrame]]:
    """Columns in groups, each with the leading files that hold ``n`` present cells of every column of the group (or all files)."""
    left, found = list(columns), []
    for part in prefixes(df):
        if not left:
            break
        counts = part.agg(*[F.count(F.when(present[c], 1)).alias(f"n{i}") for i, c in enumerate(left)]).first()
        full = [c for i, c in enumerate(left) if counts[f"n{i}"] >= n]
        if full:
            found.append((full, part))
        left = [c for c in left if c not in full]
    return found + ([(left, df)] if left else [])
