"""Frames kept as tables in buckets of positions, for zips that move no row.

Numbering a frame moves its rows once. Kept with its numbers, in a table whose buckets are
positions, it is numbered and moved for the last time: tables of as many buckets meet bucket by
bucket, so any number of zips of them have no exchange.
"""

from __future__ import annotations

import functools
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import positions
from millrace.positions import PLACE, POS

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame

#: Rows of a bucket, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 8


class Placed:
    """A frame's rows with their positions, in buckets of them."""

    def __init__(self, frame: OrderedFrame, buckets: int | None = None):
        from millrace.session import shared_path

        if frame.by:
            raise ValueError("for a stream without keys")
        spark = frame.spark
        if buckets is None:
            buckets = LEAST_BUCKETS
            while buckets * BUCKET_ROWS < positions.rows_of(frame):  # powers of two, so tables of like size have as many
                buckets *= 2
        self.buckets, self.frame_of, self.columns, self.order = buckets, type(frame), frame.df.columns, frame.order
        self.name = f"placed_{uuid.uuid4().hex}"
        rows = positions.with_positions(frame).withColumnRenamed(POS, "_place")
        rows.repartition(buckets, "_place").write.bucketBy(buckets, "_place").sortBy("_place").option("path", shared_path(spark, "placed")).saveAsTable(self.name)
        self.df: DataFrame = spark.table(self.name)

    def frame(self) -> OrderedFrame:
        """The frame that is kept."""
        return self.frame_of(self.df.drop("_place"), self.order)

    def zip(self, *others: Placed, names: tuple[str, ...] = ()) -> OrderedFrame:
        """zip() of the kept frames."""
        kept = [self, *others]
        names = names or tuple(f"_{i + 1}" for i in range(len(kept)))
        if len(names) != len(kept) or len(kept) > 64:
            raise ValueError("a name for each of 64 frames at most")
        sides = [p.df.select("_place", F.struct(*(F.col(c) for c in p.columns)).alias(n)) for p, n in zip(kept, names, strict=True)]
        # tables of as many buckets meet as they lie; a broadcast would copy what needn't move
        whole = functools.reduce(lambda a, b: a.join(b.hint("merge"), "_place"), sides)
        return self.frame_of(whole.withColumnRenamed("_place", PLACE), (PLACE,))

    def drop(self) -> None:
        """Forgets the table; its files go with the session."""
        self.df.sparkSession.sql(f"drop table if exists {self.name}")
