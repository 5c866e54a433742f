"""One stream into several."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from millrace import positions
from millrace.operators.cycles import settled
from millrace.positions import POS

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame


class FanOut:
    def broadcast(self, *branches: Callable[[OrderedFrame], Any], keep: bool = False) -> list:
        """Each branch's result for this frame. keep: the rows are computed once for all."""
        source = self.with_df(self.df.persist(StorageLevel.MEMORY_AND_DISK)) if keep else self
        return [branch(source) for branch in branches]

    def tee(self, drain: Callable[[OrderedFrame], Any]) -> OrderedFrame:
        """This frame, after drain has had it too."""
        drain(self)
        return self

    def switch(self, n: int, index: Column) -> list[OrderedFrame]:
        """n frames: rows by index from 0; the job fails for another index."""
        ok = F.when(index.isNull() | (index < 0) | (index >= n), F.raise_error(F.lit("no such branch")).cast("boolean")).otherwise(F.lit(True))
        checked = self.df.where(ok)
        return [self.with_df(checked.where(index == i)) for i in range(n)]

    def fan_out_round_robin(self, n: int) -> list[OrderedFrame]:
        df = settled(positions.with_positions(self))  # once for all branches
        return [self.with_df(df.where(F.col(POS) % n == i).drop(POS)) for i in range(n)]

    def fan_out_sequential(self, lengths: list[int]) -> list[OrderedFrame]:
        """Frames of the given lengths in turn, as branches that take so many would get, and one of what is left."""
        df, at, out = settled(positions.with_positions(self)), 0, []
        for n in lengths:
            out.append(self.with_df(df.where((F.col(POS) >= at) & (F.col(POS) < at + n)).drop(POS)))
            at += n
        return [*out, self.with_df(df.where(F.col(POS) >= at).drop(POS))]

    def fan_out_to_any(self, n: int) -> list[OrderedFrame]:
        """n frames, rows by the hash of their order."""
        place = F.pmod(F.xxhash64(*self.order), F.lit(n))
        return [self.with_df(self.df.where(place == i)) for i in range(n)]

    def unzip(self, column: str) -> list[OrderedFrame]:
        """A frame for each field of a struct column."""
        return [self.map(**{f.name: F.col(column)[f.name]}) for f in self.df.schema[column].dataType.fields]
