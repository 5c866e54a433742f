"""Time and rate, read on an event-time column.

ts names a timestamp column that doesn't fall in the frame's order. Durations are in
microseconds. start is a stream's start, in microseconds since 1970; by default it is the
first ts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from millrace import positions
from millrace.operators.groups import in_order
from millrace.operators.slicing import at_least
from millrace.positions import POS

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame

DROP_HEAD, DROP_TAIL, DROP_BUFFER, DROP_NEW, FAIL = OVERFLOWS = ("DropHead", "DropTail", "DropBuffer", "DropNew", "Fail")


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


class Timed:
    def _since_start(self, ts: str, start: int | None) -> Column:
        if start is not None:
            return micros(ts) - F.lit(start)
        if self.by:
            return micros(ts) - F.min(micros(ts)).over(Window.partitionBy(*self.by))
        return micros(ts) - self.df.agg(F.min(micros(ts))).scalar()

    def take_within(self, duration: int, ts: str, start: int | None = None) -> OrderedFrame:
        return self.with_df(self.df.withColumn("_at", self._since_start(ts, start)).where(F.col("_at") < duration).drop("_at"))

    def drop_within(self, duration: int, ts: str, start: int | None = None) -> OrderedFrame:
        return self.with_df(self.df.withColumn("_at", self._since_start(ts, start)).where(F.col("_at") >= duration).drop("_at"))

    def delay(self, duration: Column, ts: str, name: str = "emitted") -> OrderedFrame:
        """name: when each row leaves (microseconds), if each is held for its duration after it came and the one before left.

        t(i) = max(a(i), t(i-1)) + d(i): with S the running sum of d, t(i) - S(i) is the
        greatest a(j) - S(j-1) so far.
        """
        summed = self.with_df(positions.running(self, _whole=("sum", duration.cast("long"))).drop(POS))
        df = positions.running(summed, _most=("max", micros(ts) - (F.col("_whole") - duration.cast("long"))))
        return self.with_df(df.withColumn(name, F.col("_whole") + F.col("_most")).drop(POS, "_whole", "_most"))

    def throttle(self, elements: int, per: int, ts: str, burst: int = 1, cost: Column | None = None, name: str = "emitted") -> OrderedFrame:
        """name: when each row leaves a token bucket (microseconds) that gets elements tokens in per and holds burst.

        A row leaves in the first microsecond in which it has come, the row before has left,
        and there are tokens for its cost (1). With times in tokens' time, the bucket is empty
        of all that was promised at x(i) = max(x(i-1), a(i)) + c(i), so with S the running sum
        of costs x(i) - S(i) is the greatest a(j) - S(j-1) so far, and a row leaves a bucket's
        worth before x(i).
        """
        at_least("elements", elements, 1)
        at_least("burst", burst)
        need = ((F.lit(1) if cost is None else cost).cast("long") * per).cast("long")
        summed = self.with_df(positions.running(self.with_columns(_need=need), _whole=("sum", F.col("_need"))).drop(POS))
        df = positions.running(summed, _most=("max", micros(ts) * elements - (F.col("_whole") - F.col("_need"))), _came=("max", micros(ts)))
        df = df.withColumn("_ahead", F.col("_whole") + F.col("_most") - burst * per)
        due = F.expr(f"(_ahead + pmod(-_ahead, {elements})) div {elements}")  # rounded up, in whole numbers
        return self.with_df(df.withColumn(name, F.greatest("_came", due)).drop(POS, "_need", "_whole", "_most", "_came", "_ahead"))

    def _fails(self, where: Column, why: str) -> Column:
        return F.when(where, F.raise_error(F.lit(f"StreamTimeout: {why}")).cast("boolean")).otherwise(F.lit(True))

    def gaps(self, ts: str, name: str = "gap") -> OrderedFrame:
        """name: microseconds since the row before, null for the first."""
        df = positions.beside(self, back=1, **{name: lambda w: micros(ts) - F.lag(micros(ts)).over(w)})
        return self.with_df(df.drop(POS))

    def with_idle_timeout(self, duration: int, ts: str) -> OrderedFrame:
        """The job fails where a row comes more than duration after the one before."""
        return self.with_df(self.gaps(ts, "_gap").df.where(self._fails(F.col("_gap") > duration, "idle")).drop("_gap"))

    def with_initial_timeout(self, duration: int, ts: str, start: int) -> OrderedFrame:
        """The job fails if the first row comes more than duration after start."""
        first = self.df.agg(F.min(micros(ts))).scalar()
        return self.with_df(self.df.where(self._fails(first - start > duration, "no first element")))

    def with_completion_timeout(self, duration: int, ts: str, start: int | None = None) -> OrderedFrame:
        """The job fails if a row comes more than duration after start."""
        return self.with_df(self.df.withColumn("_at", self._since_start(ts, start)).where(self._fails(F.col("_at") > duration, "not complete")).drop("_at"))

    def _windowed(self, duration: int, ts: str) -> Column:
        return (F.floor(micros(ts) / duration) * duration).cast("long")

    def conflate_with_seed(self, duration: int, ts: str, name: str = "started", **aggregates: Column) -> OrderedFrame:
        """A row for each duration that has elements, as a consumer that asks once in each would get; aggregates of its rows."""
        df = self.df.groupBy(*self.by, self._windowed(duration, ts).alias(name)).agg(*(a.alias(n) for n, a in aggregates.items()))
        return self.within(df, (name,))

    def conflate(self, duration: int, ts: str, value: Column, name: str = "values") -> OrderedFrame:
        """conflate_with_seed() into arrays of the values in order."""
        return self.conflate_with_seed(duration, ts, **{name: in_order(F.struct(*self.order), value)})

    def conflate_to_last(self, duration: int, ts: str) -> OrderedFrame:
        """The last row of each duration."""
        whole = F.struct(*self.df.columns)
        df = self.df.groupBy(*self.by, self._windowed(duration, ts).alias("_at")).agg(F.max_by(whole, F.struct(*self.order)).alias("_row"))
        return self.with_df(df.select("_row.*"))

    sample = conflate_to_last

    def expand(self, step: int, ts: str, name: str = "at") -> OrderedFrame:
        """Each row once, and again each step until the next row comes; name: when (microseconds)."""
        at_least("step", step, 1)
        positions.fresh(self.df, name)
        df = positions.beside(self, ahead=1, _next=lambda w: F.lead(micros(ts)).over(w)).drop(POS)
        upto = F.greatest(micros(ts), F.coalesce(F.col("_next") - 1, micros(ts)))
        df = df.withColumn(name, F.explode(F.sequence(micros(ts), upto, F.lit(step).cast("long")))).drop("_next")
        return self.within(df, (*self.order, name)).grown()

    def expand_with(self, step: int, ts: str, extrapolate: Callable[[Column], Column], name: str = "at") -> OrderedFrame:
        """expand(), with columns extrapolated(n): extrapolate of the number of the repeat, 0 for the row itself."""
        out = self.expand(step, ts, name)
        return out.with_df(out.df.withColumn("extrapolated", extrapolate(F.floor((F.col(name) - micros(ts)) / step))))

    def expand_from(self, zero: Any, step: int, ts: str, start: int, value: Column, extrapolate: Callable[[Column, Column], Column], name: str = "at", out: str = "extrapolated") -> OrderedFrame:
        """name and out: extrapolate(value, n) of each row, n times a step after it until the next comes; before the first, from start on, of zero.

        For a stream without keys; of an empty one there is what zero gives at start.
        """
        if self.by:
            raise ValueError("for a stream without keys")
        at_least("step", step, 1)
        kind = self.df.select(value.alias("v")).schema["v"].dataType
        whole = self.with_df(self.df.withColumn("_value", value)).expand(step, ts, name)
        n = F.floor((F.col(name) - micros(ts)) / step)
        # rows of one time have one step each: the order's own columns tell them apart
        rows = whole.df.select(F.col(name), F.lit(True).alias("is_row"), F.struct(*self.order).alias("row_of"), extrapolate(F.col("_value"), n).alias(out))
        first = F.coalesce(self.df.agg(F.min(micros(ts))).scalar(), F.lit(start + 1))
        upto = F.greatest(F.lit(start).cast("long") - 1, first - 1)
        times = F.when(upto >= start, F.sequence(F.lit(start).cast("long"), upto, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
        none = F.lit(None).cast(rows.schema["row_of"].dataType)
        before = self.spark.range(1).select(F.explode(times).alias(name)).select(name, F.lit(False).alias("is_row"), none.alias("row_of"), extrapolate(F.lit(zero).cast(kind), F.floor((F.col(name) - start) / step)).alias(out))
        return self.within(before.unionByName(rows), (name, "is_row", "row_of")).grown()

    def buffer_dropping(self, size: int, ts: str, demand_micros: int, strategy: str = DROP_HEAD) -> OrderedFrame:
        """The rows that a buffer of size elements has left for a consumer that empties it once in each demand_micros.

        Of what comes between two such times DropHead leaves the last, DropNew the first,
        DropTail the first and the last one, and DropBuffer what came since the buffer was
        last full and thrown away; with Fail the job fails if anything must go.
        """
        at_least("size", size, 1)
        if strategy not in OVERFLOWS:
            raise ValueError(f"one of {OVERFLOWS}")
        span = Window.partitionBy(*self.by, "_asked")
        df = self.df.withColumn("_asked", self._windowed(demand_micros, ts)).withColumns({"_nth": F.row_number().over(span.orderBy(*self.order)), "_n": F.count("*").over(span)})
        nth, n = F.col("_nth"), F.col("_n")
        left = {
            DROP_HEAD: nth > n - size,
            DROP_NEW: nth <= size,
            DROP_TAIL: (nth < size) | (nth == n),
            DROP_BUFFER: nth > F.floor((n - 1) / size) * size,
            FAIL: F.when(n > size, F.raise_error(F.lit("BufferOverflow")).cast("boolean")).otherwise(F.lit(True)),
        }[strategy]
        return self.with_df(df.where(left).drop("_asked", "_nth", "_n"))
