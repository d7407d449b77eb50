"""CSV files whose quoted cells hold newlines, read by many tasks a file.

Spark's ``multiLine`` gives a file to one task.  Here the text source splits a file at newlines, and a newline ends a record unless a quoted
cell is open there.  A line takes the reader from "outside" or "inside" a quoted cell to one of the two, so a split is one of four maps
(keep, swap, always outside, always inside) whatever came before it.  The first scan works out the map of each split; a window over the
splits of a file composes them to the state in which each split starts; the second scan cuts records.  Only the pieces of records that
reach over a split's border are shuffled, at most two a split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions.text import sql_ident
from veilframe.session import scratch_path, ship_package

SENT = 1_000_000      # splits whose starting states are broadcast at most, about 150 bytes each
SPLIT = ["path", "block", "length"]
MOVES = "path string, block bigint, length bigint, from_outside boolean, from_inside boolean"
PIECES = "path string, block bigint, piece int, header boolean, text string"
WHOLE, HEAD, MIDDLE, TAIL = range(4)


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of ``line`` when one was (or was not) open at its start.

    A quote opens a cell only as the cell's first character, a doubled quote is a character of the cell, and what
    follows a closing quote up to the comma belongs to the cell.
    """
    at, n = 0, len(line)
    while True:
        if not inside:
            if at >= n or line[at] != '"':
                at = line.find(",", at)
                if at < 0:
                    return False
                at += 1
                continue
            at += 1
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at, inside = at + 2, True
            continue
        at = line.find(",", at + 1)
        if at < 0:
            return False
        at, inside = at + 1, False


def _rows(batches, *names):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def split_maps(batches):
    """One row per split: where it leads from outside and from inside a quoted cell."""
    def row():
        columns = [[k] for k in key] + [[out], [into]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))],
                                          ["path", "block", "length", "from_outside", "from_inside"])

    key, out, into = None, False, True
    for line, *split in _rows(batches, "value", *SPLIT):
        if split != key:
            if key:
                yield row()
            key, out, into = split, False, True
        if '"' in line:
            together = out == into
            out = inside_after(line, out)
            into = out if together else inside_after(line, into)
    if key:
        yield row()


def cut(batches, whole: bool, rows: int = 2000):
    """The whole records of the splits, or the pieces of those that reach over a border.

    A piece is a head (ends in the split), a middle (fills it) or a tail (begins in it).  A file's first record that is not empty is its header.
    """
    done = []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))],
                                           ["path", "block", "piece", "header", "text"])
        done.clear()
        return batch

    def take(piece):
        nonlocal header
        text = "\n".join(lines)
        first = header and piece in (WHOLE, TAIL) and text not in ("", "\r")
        header = header and not first
        if (piece == WHOLE) == whole and not (whole and first):
            done.append((*key[:2], piece, first, text))
        lines.clear()

    key, lines, state, begun, header = None, [], False, True, False
    for line, start, *split in _rows(batches, "value", "inside", *SPLIT):
        if split != key:
            if lines:
                take(TAIL if begun else MIDDLE)
            key, state, begun, header = split, start, not start, split[1] == 0
        lines.append(line)
        if '"' in line:
            state = inside_after(line, state)
        if not state:
            take(WHOLE if begun else HEAD)
            begun = True
        if len(done) >= rows:
            yield flush()
    if lines:
        take(TAIL if begun else MIDDLE)
    if done:
        yield flush()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", meta.file_path.alias("path"), meta.file_block_start.alias("block"), meta.file_block_length.alias("length"))


def split_starts(maps: DataFrame) -> DataFrame:
    """The state in which each split starts: that of the last split before it with one outcome, turned by every swap since."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    settled = F.col("from_outside") == F.col("from_inside")
    swap = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    counted = maps.withColumn("swaps", F.sum(swap).over(upto))
    last = F.last(F.when(settled, F.struct(F.col("from_outside").alias("inside"), "swaps")), ignorenulls=True).over(before)
    swapped = F.coalesce(F.lag("swaps").over(Window.partitionBy("path").orderBy("block")), F.lit(0))
    at = counted.select(*SPLIT, last.alias("last"), swapped.alias("swapped"))
    turned = (F.col("swapped") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    return at.select(*SPLIT, (F.coalesce("last.inside", F.lit(False)) != turned).alias("inside"))


def records(spark: SparkSession, path: str, sent: int = SENT) -> DataFrame:
    """``record`` (string): every record of the CSV files but headers and empty ones, without the line end.

    Lines end in LF or CRLF.  A quoted cell that is never closed reaches to the end of its file.  The splits' states are
    written to the shared folder first and broadcast up to ``sent`` splits; beyond, the lines are joined by shuffle and sorted
    back.  If the splits of the second scan are not those of the first (other settings or another cluster), it ends in an error.
    """
    ship_package(spark)
    lines = _lines(spark, path)
    folder = scratch_path(spark, "csv-splits")
    maps = lines.mapInArrow(split_maps, MOVES)
    split_starts(maps).write.parquet(folder)
    starts = spark.read.schema("path string, block bigint, length bigint, inside boolean").parquet(folder)
    known = F.coalesce("inside", F.raise_error(F.lit("the splits changed since they were scanned: read the CSV again")).cast("boolean"))
    if starts.count() <= sent:
        placed = lines.join(F.broadcast(starts), SPLIT, "left")
    else:
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(starts, SPLIT, "left").sortWithinPartitions(*SPLIT, "at")
    placed = placed.select("value", *SPLIT, known.alias("inside"))
    whole = placed.mapInArrow(lambda batches: cut(batches, True), PIECES).select("text")
    broken = placed.mapInArrow(lambda batches: cut(batches, False), PIECES)
    begun = F.sum((F.col("piece") == TAIL).cast("int")).over(Window.partitionBy("path").orderBy("block", "piece"))
    parts = F.array_sort(F.collect_list(F.struct("block", "piece", "text")))
    joined = broken.withColumn("nth", begun).groupBy("path", "nth").agg(F.max("header").alias("header"), parts.alias("parts")) \
        .where("NOT header").select(F.array_join(F.col("parts.text"), "\n").alias("text"))
    record = F.when(F.endswith("text", F.lit("\r")), F.expr("substr(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    return whole.union(joined).select(record.alias("record")).where("record <> ''")


def read_records(spark: SparkSession, path: str, options: dict[str, str], sent: int = SENT) -> DataFrame:
    """The CSV files as a table of string columns, equal to ``spark.read.options(multiLine=True)`` but for the order of rows."""
    options = dict(options, multiLine="true")
    schema = spark.read.options(**options).csv(path).schema        # reads the first record only
    ddl = ", ".join(f"{sql_ident(f.name)} string" for f in schema.fields)
    return records(spark, path, sent).select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
