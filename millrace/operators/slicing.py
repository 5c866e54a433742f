"""Limits and slices by position."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from millrace import positions
from millrace.positions import POS

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame


def at_least(name: str, n: int, least: int = 0) -> None:
    if n < least:
        raise ValueError(f"{name} must be {least} or more")


class Slicing:
    def _positioned(self, where: Column) -> OrderedFrame:
        return self.with_df(positions.with_positions(self).where(where).drop(POS))

    def _ranked(self, n: int, descending: bool) -> OrderedFrame:
        rank = F.row_number().over(self.window(descending))
        return self.with_df(self.df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank"))

    def take(self, n: int) -> OrderedFrame:
        at_least("n", n)
        if self.by:
            return self._ranked(n, False)
        if n > positions.CHUNK_ROWS:  # more than one task is to hold
            return self._positioned(F.col(POS) < n)
        return self.with_df(self.df.orderBy(*self.order).limit(n))

    def first(self) -> OrderedFrame:
        return self.take(1)

    def drop(self, n: int) -> OrderedFrame:
        at_least("n", n)
        return self._positioned(F.col(POS) >= n) if n else self

    def drop_all(self) -> OrderedFrame:
        return self.with_df(self.df.limit(0))

    def take_last(self, n: int) -> OrderedFrame:
        """The last n, none for n <= 0."""
        if n <= 0:
            return self.drop_all()
        if self.by:
            return self._ranked(n, True)
        if n > positions.CHUNK_ROWS:
            df = positions.with_positions(self).withColumn("_n", self.df.agg(F.count("*")).scalar())
            return self.with_df(df.where(F.col(POS) >= F.col("_n") - n).drop(POS, "_n"))
        return self.with_df(self.df.orderBy(*(F.col(c).desc() for c in self.order)).limit(n))

    def last(self) -> OrderedFrame:
        return self.take_last(1)

    def drop_last(self, n: int) -> OrderedFrame:
        at_least("n", n)
        if not n:
            return self
        df = positions.with_positions(self)
        if self.by:
            counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(*self.by)))
        else:
            counted = df.withColumn("_n", self.df.agg(F.count("*")).scalar())
        return self.with_df(counted.where(F.col(POS) < F.col("_n") - n).drop(POS, "_n"))

    def _while(self, where: Column, prefix: bool) -> OrderedFrame:
        broken = (~F.coalesce(where, F.lit(False))).cast("int")
        if self.by:
            span = self.window().rowsBetween(Window.unboundedPreceding, 0)
            df = self.df.withColumn("_broken", F.max(broken).over(span))
            return self.with_df(df.where(F.col("_broken") == (0 if prefix else 1)).drop("_broken"))
        # the first row that breaks the prefix, by which each row then sees its side
        key = F.struct(*self.order)
        df = self.df.withColumn("_end", self.df.where(broken == 1).agg(F.min(key)).scalar())
        before = F.col("_end").isNull() | (key < F.col("_end"))
        return self.with_df(df.where(before if prefix else ~before).drop("_end"))

    def take_while(self, where: Column) -> OrderedFrame:
        """The rows before the first for which where isn't true."""
        return self._while(where, True)

    def drop_while(self, where: Column) -> OrderedFrame:
        """The first row for which where isn't true, and all after it."""
        return self._while(where, False)

    def element_at(self, index: int) -> OrderedFrame:
        """The element at index, from 0; nothing where there is none."""
        at_least("index", index)
        return self._positioned(F.col(POS) == index)

    def slice(self, start: int, length: int) -> OrderedFrame:
        at_least("start", start)
        at_least("length", length)
        return self._positioned((F.col(POS) >= start) & (F.col(POS) < start + length))

    def slice_every(self, drop: int, take: int) -> OrderedFrame:
        """Of each drop + take elements the last take."""
        at_least("drop", drop)
        at_least("take", take)
        if not take:
            return self.drop_all()
        return self._positioned(F.col(POS) % (drop + take) >= drop)

    def take_every_nth(self, n: int) -> OrderedFrame:
        at_least("n", n, 1)
        return self._positioned(F.col(POS) % n == n - 1)

    def with_limit(self, most: int) -> OrderedFrame:
        """All rows; the job fails if there are more than most."""
        return self.with_limit_weighted(most, F.lit(1))

    def with_limit_weighted(self, most: float, cost: Column) -> OrderedFrame:
        """All rows; the job fails where the costs so far exceed most."""
        df = positions.running(self, _cost=("sum", cost))
        ok = F.when(F.col("_cost") > most, F.raise_error(F.lit(f"StreamLimitExceeded: more than {most}")).cast("boolean")).otherwise(F.lit(True))
        return self.with_df(df.where(ok).drop(POS, "_cost"))
