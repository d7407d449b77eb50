"""Reaching k.  Quasi-identifiers become ranges, by recursive median cuts, until no cut leaves k rows on both sides.

All open boxes of a level are cut in one pass: one aggregation takes each box's medians and ranges, a second counts the two sides of the cuts, and
the rows move into the halves.  Box 1 holds all rows, box b is cut into 2b and 2b + 1.

A box that can be cut along a column can be cut at its median m, below it or above it: if both leave fewer than k rows on a side, so does any other
place.  ``percentile_approx`` finds m within a rank of n / accuracy; with an accuracy of 4k or more it is exact in boxes of up to 4k rows, and in
larger ones far from where k matters, so the argument holds for it too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import as_text, col
from veilframe.operators.joins import skew_join
from veilframe.operators.value_key import drop_folder, saved
from veilframe.session import scratch_path

ACCURACY = 10_000      # of a median, at least: ranks are off by a 10,000th of the box's rows at most
SENT = 1_000_000       # boxes whose medians and cuts are broadcast at most, 16 bytes a column and 40 bytes
MISSING = float("-inf")


def _number(df: DataFrame, name: str):
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.coalesce(F.unix_date(col(name)).cast("double"), F.lit(MISSING))
    if not isinstance(dtype, T.NumericType):
        raise ValueError(f"column {name!r} is neither a number nor a date: generalize it first")
    v = col(name).cast("double")
    return F.when(F.isnan(v), F.lit(MISSING)).when(v == 0, F.lit(0.0)).otherwise(F.coalesce(v, F.lit(MISSING)))      # no -0.0


def _cuts(rows: DataFrame, dims: list[str], k: int, widths: dict[str, float], folder: str, sent: int) -> DataFrame:
    """(box, dim, at, below): a cut of every box of ``rows`` that has one; ``below``: the median itself goes up.

    Of the columns that can be cut it takes the one that spans most of its whole range, the first of equals; of the two places the more even.
    """
    accuracy = max(ACCURACY, 4 * k)
    found = rows.groupBy("box").agg(F.count(F.lit(1)).alias("n"), *[
        e for d in dims for e in (F.percentile_approx(d, 0.5, accuracy).alias(f"m_{d}"), (F.max(d) - F.min(d)).alias(f"w_{d}"))]).where(F.col("n") >= 2 * k)
    medians = saved(found.select("box", "n", *[F.col(f"m_{d}") for d in dims], *[
        F.when(F.col(f"w_{d}") == float("inf"), 1.0).otherwise(F.col(f"w_{d}") / widths[d]).alias(f"w_{d}") for d in dims]), folder)
    sides = rows.join(F.broadcast(medians) if medians.count() <= sent else medians, "box").groupBy("box").agg(
        F.first("n").alias("n"), *[e for d in dims for e in (
            F.first(f"m_{d}").alias(f"m_{d}"), F.first(f"w_{d}").alias(f"w_{d}"),
            F.count(F.when(F.col(d) < F.col(f"m_{d}"), 1)).alias(f"lt_{d}"), F.count(F.when(F.col(d) <= F.col(f"m_{d}"), 1)).alias(f"le_{d}"))])

    def choice(i, d, below):
        low = F.col(f"{'lt' if below else 'le'}_{d}")
        small = F.least(low, F.col("n") - low)
        return F.when(small >= k, F.struct(F.col(f"w_{d}").alias("width"), F.lit(-i).alias("first"), small.alias("small"), F.lit(below).alias("below"),
                                           F.lit(i).alias("dim"), F.col(f"m_{d}").alias("at")))
    best = F.array_max(F.array_compact(F.array(*[choice(i, d, b) for i, d in enumerate(dims) for b in (False, True)])))
    return sides.select("box", best.alias("best")).where("best IS NOT NULL").select("box", "best.dim", "best.at", "best.below")


def generalize_to_k(df: DataFrame, quasi_identifiers: list[str], k: int, sent: int = SENT) -> DataFrame:
    """``df`` with each quasi-identifier (numbers, dates) as the range of its class, ``low..high`` as text, and ``k``, the rows of the class.

    Every class has at least ``k`` rows, unless the whole table has fewer: then it is one class, and ``k`` says its size.  No class
    could be cut further along any column.  Missing values (null, NaN) count as the smallest and print as ``-``; dates as
    days, numbers as doubles.  Rows of equal quasi-identifiers stay together, so ties decide nothing.  An empty table gives an empty
    one.  Each level's rows (the quasi-identifiers only) are written to the shared folder; the result reads the last level's classes.
    """
    if "k" in df.columns:
        raise ValueError("the table has a column k already")
    dims = [f"d{i}" for i in range(len(quasi_identifiers))]
    numbers = [_number(df, c).alias(d) for c, d in zip(quasi_identifiers, dims)]
    spark, root = df.sparkSession, scratch_path(df.sparkSession, "boxes")
    rows = saved(df.select(F.lit(1).cast("bigint").alias("box"), *numbers), f"{root}/rows-0")
    spans = rows.agg(*[(F.max(F.when(F.col(d) > MISSING, F.col(d))) - F.min(F.when(F.col(d) > MISSING, F.col(d)))).alias(d) for d in dims]).first()
    widths = {d: spans[d] or 1.0 for d in dims}
    closed, level = [], 0
    while True:
        cuts = saved(_cuts(rows, dims, k, widths, f"{root}/medians-{level}", sent), f"{root}/cuts-{level}")
        drop_folder(spark, f"{root}/medians-{level}")
        n = cuts.count()
        placed = rows.join(F.broadcast(cuts) if n <= sent else cuts, "box", "left")
        closed.append(saved(_classes(placed.where("dim IS NULL"), dims), f"{root}/closed-{level}"))
        if n == 0:
            break
        value = F.element_at(F.array(*dims), F.col("dim") + 1)
        up = F.when(F.col("below"), value >= F.col("at")).otherwise(value > F.col("at"))
        level += 1
        rows = saved(placed.where("dim IS NOT NULL").select((F.col("box") * 2 + up.cast("int")).alias("box"), *dims), f"{root}/rows-{level}")
        drop_folder(spark, f"{root}/rows-{level - 1}")
        drop_folder(spark, f"{root}/cuts-{level - 1}")
    classes = reduce(DataFrame.union, closed)
    key = F.to_json(F.struct(*[F.col(d).cast("string").alias(d) for d in dims]))
    tuples = classes.select(key.alias("__qi"), *[F.col(f"r_{d}") for d in dims], "k")
    keyed = df.select("*", F.to_json(F.struct(*[n.cast("string").alias(d) for n, d in zip(
        [_number(df, c) for c in quasi_identifiers], dims)])).alias("__qi"))
    joined = skew_join(keyed, tuples, "__qi", "inner")
    ranges = dict(zip(quasi_identifiers, dims))
    return joined.select(*[F.col(f"r_{ranges[c]}").alias(c) if c in ranges else col(c) for c in df.columns], "k")


def _classes(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Every different tuple of the closed boxes with its box's ranges and size; boxes are summed up first, then their tuples joined with them."""
    def show(c):
        return F.when(c == MISSING, F.lit("-")).otherwise(F.regexp_replace(as_text(c, T.DoubleType()), r"\.0$", ""))
    boxes = rows.groupBy("box").agg(F.count(F.lit(1)).alias("k"), *[F.concat(show(F.min(d)), F.lit(".."), show(F.max(d))).alias(f"r_{d}") for d in dims])
    return rows.select("box", *dims).distinct().join(boxes, "box").select(*dims, *[f"r_{d}" for d in dims], "k")
