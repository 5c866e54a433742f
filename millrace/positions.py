"""Positions, running values and neighbours over a global order, without one task for all.

A window without keys moves every row to one task. Here a range shuffle on the whole order
deals rows to ranges of some CHUNK_ROWS (rows that share the leading column may be in
several), the ranged rows are kept, and the ranges' sizes give each range's first position;
positions cut the rows into chunks of equal size. A running value is one per chunk, plus what
earlier chunks come to; a neighbour within k rows is found in a chunk with the last (or first)
k rows of the chunks beside it.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.cycles import settled

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame

#: Rows that one task orders.
CHUNK_ROWS = 1_000_000
#: Columns of positions inside of operators, and of positions that are a result.
POS, CHUNK, PLACE = "_pos", "_chunk", "pos"


def free(name: str, taken: Iterable[str]) -> str:
    """name, or name_2, name_3 and so on: the first that isn't taken."""
    names, n = {x.lower() for x in taken}, 1
    while (found := name if n == 1 else f"{name}_{n}").lower() in names:
        n += 1
    return found


def fresh(df: DataFrame, *names: str) -> None:
    """An error where df has one of names, which a result is to have."""
    taken = sorted({x.lower() for x in names} & {c.lower() for c in df.columns})
    if taken:
        raise ValueError(f"columns {taken} are there already: rename them first")


def _ranges(frame: OrderedFrame) -> int:
    """The ranges to which a frame without keys is dealt: one for what one task can order.

    A frame is counted once: what is made of it has no more rows, so the number serves it too.
    """
    return rows_of(frame) // CHUNK_ROWS + 1


def rows_of(frame: OrderedFrame) -> int:
    """How many rows frame has at most."""
    if frame.bound.known is None:
        frame.bound.n = frame.df.count()
    return frame.bound.known


def with_positions(frame: OrderedFrame, ranges: int | None = None) -> DataFrame:
    """frame's rows with POS: their place in the order, from 0."""
    fresh(frame.df, POS, CHUNK)
    if frame.by:
        return frame.df.withColumn(POS, (F.row_number().over(frame.window()) - 1).cast("long"))
    ranges = ranges or _ranges(frame)
    if ranges == 1:
        return frame.df.withColumn(POS, (F.row_number().over(Window.orderBy(*frame.order)) - 1).cast("long"))
    ranged = frame.df.repartitionByRange(ranges, *frame.order).sortWithinPartitions(*frame.order)
    # a row's number in its part; kept, as ranges are drawn anew each time they are computed
    ranged = settled(ranged.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))  # a row for each range
    return ranged.join(F.broadcast(firsts), "_range").withColumn(POS, F.col("_first") + F.col("_place")).drop("_range", "_place", "_first")


def numbered(frame: OrderedFrame, name: str = PLACE) -> DataFrame:
    """frame's rows with their place in the order, from 0, as a column name."""
    fresh(frame.df, name)
    return with_positions(frame).withColumnRenamed(POS, name)


def chunked(frame: OrderedFrame) -> tuple[DataFrame, list[str]]:
    """frame's rows with POS and the columns to partition windows by (keys, or the chunk; none if there is but one)."""
    ranges = 1 if frame.by else _ranges(frame)
    df = with_positions(frame, ranges)
    if ranges == 1:
        return df, list(frame.by)
    return df.withColumn(CHUNK, F.floor(F.col(POS) / CHUNK_ROWS)), [CHUNK]


def running(frame: OrderedFrame, inclusive: bool = True, **values: tuple[str, Column]) -> DataFrame:
    """frame's rows with POS and, for each name=(how, value), the value's sum, min, max or count up to the row.

    Not inclusive: up to the row before; null (0 for count and sum) where there is none.
    """
    df, parts = chunked(frame)
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    join = {"sum": operator.add, "count": operator.add, "min": F.least, "max": F.greatest}
    span = Window.partitionBy(*parts).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df
    for name, (how, value) in values.items():
        out = out.withColumn(name, kinds[how](value).over(span))
        if how in ("sum", "count"):
            out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    if CHUNK not in parts:
        return out
    totals = df.groupBy(CHUNK).agg(*(kinds[how](value).alias(f"_t_{name}") for name, (how, value) in values.items()))
    earlier = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(CHUNK, *(kinds["sum" if how == "count" else how](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (how, _) in values.items()))  # a row for each chunk
    out = out.join(F.broadcast(carries), CHUNK)
    for name, (how, _) in values.items():
        carry = F.col(f"_c_{name}")
        out = out.withColumn(name, (F.col(name) + F.coalesce(carry, F.lit(0))) if how in ("sum", "count") else join[how](F.col(name), carry))
    return out.drop(CHUNK, *(f"_c_{name}" for name in values))


def with_halo(df: DataFrame, back: int = 0, ahead: int = 0) -> DataFrame:
    """df (with POS) with CHUNK and _own: each chunk's own rows, and copies of the rows up to back before and ahead after them."""
    first, last = (F.floor((F.col(POS) + F.lit(d)) / CHUNK_ROWS) for d in (-ahead, back))
    halo = df.withColumn(CHUNK, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return halo.withColumn("_own", F.col(CHUNK) == F.floor(F.col(POS) / CHUNK_ROWS))


def beside(frame: OrderedFrame, back: int = 0, ahead: int = 0, **values: Callable[[WindowSpec], Column]) -> DataFrame:
    """frame's rows with POS and name=value, where value() is a window function over rows within back and ahead of a row.

    Each value is a function of a WindowSpec (ordered by POS) that gives a column.
    """
    df, parts = chunked(frame)
    spec = Window.partitionBy(*parts).orderBy(POS)
    if CHUNK not in parts:
        return df.select("*", *(f(spec).alias(name) for name, f in values.items()))
    halo = with_halo(df, back, ahead)
    return halo.select("*", *(f(spec).alias(name) for name, f in values.items())).where("_own").drop("_own", CHUNK)
