"""OrderedFrame: a DataFrame with an explicit total order, and the operators on it.

Rows of a DataFrame have no order, so a frame names the columns that give a total one. by
names the keys of sub-streams: a frame with keys is a stream for each key, and every
operator works on each by itself. Streams of streams of streams have a path of keys: levels
says how many columns of by each level has, from the outermost on. What cuts streams into
sub-streams adds a level, what flattens them takes the innermost away.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.cycles import settled
from millrace.operators.elements import Elements
from millrace.operators.fanin import FanIn
from millrace.operators.fanout import FanOut
from millrace.operators.folds import Folds
from millrace.operators.groups import Groups
from millrace.operators.recovery import Recovery
from millrace.operators.slicing import Slicing
from millrace.operators.timed import Timed
from millrace.sinks import Sinks


class Bound:
    """How many rows a frame has at most, once that was counted for it or for a frame that it was made of."""

    def __init__(self, of: Bound | None = None):
        self.n: int | None = None
        self.of = of

    @property
    def known(self) -> int | None:
        at: Bound | None = self
        while at is not None and at.n is None:
            at = at.of
        return None if at is None else at.n


@dataclass(frozen=True)
class OrderedFrame(Elements, Slicing, Groups, Folds, FanIn, FanOut, Timed, Recovery, Sinks):
    """df in the total order of the columns order, within each value of the columns by."""

    df: DataFrame
    order: tuple[str, ...]
    by: tuple[str, ...] = ()
    levels: tuple[int, ...] | None = None
    bound: Bound = field(default_factory=Bound, compare=False, repr=False)

    def __post_init__(self) -> None:
        if self.levels is None:
            object.__setattr__(self, "levels", (len(self.by),) if self.by else ())
        twice = sorted({c for names in (self.order, self.by) for c in names if names.count(c) > 1})
        if twice or sum(self.levels) != len(self.by):
            raise ValueError(f"columns {twice} are in the order or the keys twice" if twice else "levels don't fit the keys")

    @classmethod
    def of(cls, df: DataFrame, order: str | Sequence[str], by: str | Sequence[str] = ()) -> OrderedFrame:
        names = lambda x: (x,) if isinstance(x, str) else tuple(x)
        frame = cls(df, names(order), names(by))
        missing = [c for c in (*frame.order, *frame.by) if c not in df.columns]
        if missing or not frame.order:
            raise ValueError(f"no such columns: {missing}" if missing else "an order is needed")
        return frame

    @property
    def spark(self):
        return self.df.sparkSession

    @property
    def values(self) -> list[str]:
        """The columns that are neither order nor key."""
        return [c for c in self.df.columns if c not in self.order and c not in self.by]

    def with_df(self, df: DataFrame) -> OrderedFrame:
        """df, which has as many rows or fewer, in the same order and streams."""
        return replace(self, df=df, bound=Bound(self.bound))

    def grown(self) -> OrderedFrame:
        """The same frame where rows have become more: their number is counted anew where it matters."""
        return replace(self, bound=Bound())

    def sub_streams(self, *by: str) -> OrderedFrame:
        """The same rows as a stream for each value of by."""
        return replace(self, by=by, levels=None)

    def within(self, df: DataFrame, order: tuple[str, ...]) -> OrderedFrame:
        """df in another order, in the same streams."""
        return replace(self, df=df, order=order, bound=Bound(self.bound))

    def cut(self, df: DataFrame, *keys: str) -> OrderedFrame:
        """df with each stream cut into sub-streams: a level of keys more."""
        return replace(self, df=df, by=(*self.by, *keys), levels=(*self.levels, len(keys)), bound=Bound(self.bound))

    @property
    def innermost(self) -> tuple[str, ...]:
        """The keys of the innermost level."""
        return self.by[len(self.by) - self.levels[-1] :] if self.levels else ()

    def joined(self, df: DataFrame, order: tuple[str, ...]) -> OrderedFrame:
        """df with the sub-streams of the innermost level as one stream each."""
        return replace(self, df=df, order=tuple(dict.fromkeys(order)), by=self.by[: len(self.by) - len(self.innermost)], levels=self.levels[:-1], bound=Bound(self.bound))

    def settled(self) -> OrderedFrame:
        """The frame with its rows computed once. For long chains: positions look at a frame's rows before its plan is made."""
        return self.with_df(settled(self.df))

    def window(self, descending: bool = False) -> WindowSpec:
        """All rows of a stream in order. Only for keyed frames: a frame without keys has one task's worth of it."""
        return Window.partitionBy(*self.by).orderBy(*(F.col(c).desc() if descending else F.col(c) for c in self.order))

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.by, *self.order)
