"""Several streams into one."""

from __future__ import annotations

import functools
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import positions
from millrace.placed import Placed
from millrace.positions import PLACE, POS, free, fresh

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame

SRC = "src"


def _numbered(frames: list[OrderedFrame]) -> tuple[DataFrame, str]:
    """All frames' rows, with the number of the frame as src (src_2 and so on where that is taken). Orders have the same columns."""
    if len({f.order for f in frames}) > 1 or any(f.by for f in frames):
        raise ValueError("frames without keys, with the same order columns")
    src = free(SRC, [c for f in frames for c in f.df.columns])
    return functools.reduce(lambda a, b: a.unionByName(b), [f.df.withColumn(src, F.lit(i)) for i, f in enumerate(frames)]), src


class FanIn:
    def attach(self, *others: OrderedFrame) -> list[OrderedFrame]:
        """The frames to fan in, from left to right."""
        return [self, *others]

    def concat(self, *others: OrderedFrame) -> OrderedFrame:
        """All of this frame, then all of each other."""
        df, src = _numbered([self, *others])
        return type(self)(df, (src, *self.order))

    def merge(self, *others: OrderedFrame) -> OrderedFrame:
        """The rows of all in the order of their order columns, which keeps that of each."""
        df, src = _numbered([self, *others])
        return type(self)(df, (*self.order, src))

    def or_else(self, *others: OrderedFrame) -> OrderedFrame:
        """The first frame that isn't empty."""
        df, src = _numbered([self, *others])
        return type(self)(df.where(F.col(src) == df.agg(F.min(src)).scalar()), (src, *self.order))

    def merge_sorted(self, *others: OrderedFrame, values: tuple[str, ...]) -> OrderedFrame:
        """Rows of all by values; ties from left to right."""
        df, src = _numbered([self, *others])
        return type(self)(df, (*values, src, *(c for c in self.order if c not in values)))

    def interleave(self, *others: OrderedFrame, segment: int = 1, eager_complete: bool = False) -> OrderedFrame:
        """segment elements of each in turn; what is left of longer ones follows, or not if eager_complete.

        An eager end comes where the first frame without an element would have its turn.
        """
        frames = [self, *others]
        # a frame's own pos, where it is its order, is what positions take the place of
        df, src = _numbered([f.with_df(positions.with_positions(f)) for f in frames])
        df = df.drop(PLACE) if self.order == (PLACE,) else df
        fresh(df, PLACE, "turn")
        turn = df.withColumnRenamed(POS, PLACE).withColumn("turn", F.floor(F.col(PLACE) / segment))
        if eager_complete:
            for i, f in enumerate(frames):
                n = f.df.agg(F.count("*")).scalar()
                turn = turn.withColumn(f"_n{i}", n)
            # a frame of n elements fails to deliver in its turn n / segment, after n % segment elements
            for i in range(len(frames)):
                last = F.floor(F.col(f"_n{i}") / segment)
                turn = turn.where((F.col("turn") < last) | ((F.col("turn") == last) & (F.col(src) <= i)))
            turn = turn.drop(*(f"_n{i}" for i in range(len(frames))))
        return type(self)(turn, ("turn", src, PLACE))

    def merge_to_either(self, other: OrderedFrame, left: Column, right: Column, name: str = "either") -> OrderedFrame:
        """merge() of structs with tag (left or right) and the value of that side."""
        a, b = (f.df.select(v.alias("v")).dtypes[0][1] for f, v in ((self, left), (other, right)))
        one = self.map(**{name: F.struct(F.lit("left").alias("tag"), left.alias("left"), F.lit(None).cast(b).alias("right"))})
        two = other.map(**{name: F.struct(F.lit("right").alias("tag"), F.lit(None).cast(a).alias("left"), right.alias("right"))})
        return one.merge(two)

    def zip(self, *others: OrderedFrame, names: tuple[str, ...] = ()) -> OrderedFrame:
        """Elements of the same position side by side, as structs (named _1, _2 or by names); ends with the shortest."""
        frames = [self, *others]
        names = names or tuple(f"_{i + 1}" for i in range(len(frames)))
        if len(names) != len(frames) or len(frames) > 64:
            raise ValueError("a name for each of 64 frames at most")
        sides = [positions.with_positions(f).select(POS, F.struct(*(F.col(c) for c in f.df.columns)).alias(n)) for f, n in zip(frames, names, strict=True)]
        return type(self)(functools.reduce(lambda a, b: a.join(b, POS), sides).withColumnRenamed(POS, PLACE), (PLACE,))

    def placed(self, buckets: int | None = None) -> Placed:
        """The frame, kept with its positions: zips of such frames move no row."""
        return Placed(self, buckets)

    #: n-ary zips into tuples, lists of different types and products with named fields.
    fan_in_to_tuple = fan_in_to_product = zip
