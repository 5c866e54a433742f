"""Folds: ordered, with an aggregate where there is one, else with a function.

A function that combines states associatively (fold_by, scan_by) is applied by many tasks; one
that takes a row at a time (fold_with, scan_with) needs a stream's rows in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import positions
from millrace.functions.digest import hasher
from millrace.operators.cycles import settled
from millrace.operators.groups import in_order
from millrace.positions import CHUNK, PLACE, POS

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


class Folds:
    def fold(self, how: str, value: Column, zero: Any, name: str = "folded") -> DataFrame:
        """One row (for each key): value folded by sum, min, max or count from zero, which an empty stream gives."""
        start = F.lit(zero)
        found = AGGREGATES[how](value)
        both = {"sum": start + found, "count": start + found, "min": F.least(start, found), "max": F.greatest(start, found)}[how]
        return self.df.groupBy(*self.by).agg(F.coalesce(both, start).alias(name))

    def reduce(self, how: str, value: Column, name: str = "reduced") -> DataFrame:
        """fold() without a zero; the job fails for an empty stream."""
        found = self.df.groupBy(*self.by).agg(AGGREGATES[how](value).alias(name), F.count("*").alias("_n"))
        some = F.when(F.col("_n") == 0, F.raise_error(F.lit("NoSuchElement: the stream is empty")).cast("boolean")).otherwise(F.lit(True))
        return found.where(some).drop("_n")

    def scan(self, how: str, value: Column, zero: Any, name: str = "scanned") -> OrderedFrame:
        """zero, then the fold up to each element: a row more than the stream has. The order is pos, -1 for zero."""
        df = positions.running(self, _run=(how, value))
        start = F.lit(zero)
        both = {"sum": start + F.col("_run"), "count": start + F.col("_run"), "min": F.least(start, "_run"), "max": F.greatest(start, "_run")}[how]
        rows = df.select(*self.by, F.col(POS).alias(PLACE), F.coalesce(both, start).alias(name))
        kind = rows.schema[name].dataType
        first = self.df.select(*self.by).distinct() if self.by else self.spark.range(1).select()
        zeros = first.select(*self.by, F.lit(-1).cast("long").alias(PLACE), start.cast(kind).alias(name))
        return self.within(rows.unionByName(zeros), (PLACE,))

    def fold_streams(self, how: str, value: Column, zero: Any, name: str = "folded") -> OrderedFrame:
        """fold() of each innermost sub-stream, as an element of the stream that it is in."""
        if not self.by:
            raise ValueError("for a stream of sub-streams")
        return self.joined(self.fold(how, value, zero, name), self.innermost)

    def _in_order(self, step: Callable[[Iterator], Iterator], columns: list[str], schema: str, empty: bool = True) -> DataFrame:
        """step over each stream's rows (tuples of columns) in order; yields result tuples.

        What needs the element before can't be dealt out, so a key's rows pass through one
        task; they do so a batch at a time, and only step's own state is held.
        """
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        kinds, keys = dict(self.df.dtypes), list(self.by)
        whole = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [schema])
        made = to_arrow_schema(StructType.fromDDL(whole))

        def serial(batches):
            import itertools

            import pyarrow as pa

            def batch_of(rows):
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)

            def same(row):  # a key of which NaN is one, as for Spark
                return [(x != x, None if x != x else x) for x in row[: len(keys)]]

            rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (*keys, *columns)), strict=True))
            held = []
            for _, own in itertools.groupby(rows, same):
                first = next(own)
                for r in step(x[len(keys) :] for x in itertools.chain([first], own)):
                    held.append((*first[: len(keys)], *r))
                    if len(held) == 10_000:
                        yield batch_of(held)
                        held = []
            if held:
                yield batch_of(held)

        rows = self.df.select(*dict.fromkeys([*keys, *self.order, *columns]))
        dealt = rows.repartition(*(F.col(c) for c in keys)) if keys else rows.repartition(1)
        done = dealt.sortWithinPartitions(*keys, *self.order).mapInArrow(serial, whole)
        # an empty stream has no row to begin with, so what it gives is added here
        none = [] if keys or not empty else list(step(iter(())))
        if not none:
            return done
        return done.unionByName(self.spark.createDataFrame(none, schema).where(~self.df.limit(1).select(F.lit(1)).exists()))

    def fold_with(self, function: Callable[[Any, tuple], Any], zero: Any, columns: list[str], kind: str, name: str = "folded") -> DataFrame:
        """One row: function(folded so far, row) over rows (tuples of columns) in order, for folds that aren't associative."""

        def step(rows):
            acc = zero
            for r in rows:
                acc = function(acc, r)
            yield (acc,)

        return self._in_order(step, columns, f"`{name}` {kind}")

    def scan_with(self, function: Callable[[Any, tuple], Any], zero: Any, columns: list[str], kind: str, name: str = "scanned") -> OrderedFrame:
        """zero, then function(so far, row) for each row in order; the order is pos, -1 for zero."""

        def step(rows):
            acc, i = zero, -1
            yield i, acc
            for i, r in enumerate(rows):  # noqa: B007
                acc = function(acc, r)
                yield i, acc

        return self.within(self._in_order(step, columns, f"{PLACE} long, `{name}` {kind}"), (PLACE,))

    #: Asynchronous steps make no difference to a fold in order.
    fold_async, scan_async = fold_with, scan_with

    def _chunks(self) -> tuple[DataFrame, list[str]]:
        """The rows with POS and CHUNK, and what tells the chunks of all streams apart."""
        df = positions.with_positions(self).withColumn(CHUNK, F.floor(F.col(POS) / positions.CHUNK_ROWS))
        return df, [*self.by, CHUNK]

    def _states(self, df: DataFrame, parts: list[str], lift: Callable, combine: Callable, columns: list[str], kind: str) -> OrderedFrame:
        """A row for each chunk: what its rows come to, combined in order; chunks in order, in the same streams."""

        def step(rows):
            whole = None
            for r in rows:
                own = lift(r)
                whole = own if whole is None else combine(whole, own)
            yield (whole,)

        chunks = replace(self, df=df, order=(POS,), by=tuple(parts), levels=None)
        return self.within(chunks._in_order(step, columns, f"_state {kind}", empty=False), (CHUNK,))

    def fold_by(self, lift: Callable[[tuple], Any], combine: Callable[[Any, Any], Any], zero: Any, columns: list[str], kind: str, name: str = "folded") -> DataFrame:
        """One row (for each key): the states that lift makes of rows (tuples of columns), combined in order, from zero.

        combine must be associative (it needn't be commutative), and kind is the type of a state
        (lists and dicts stand for arrays and structs). Chunks of rows are folded by as many
        tasks; what one task then combines, in order, is a state for each chunk.
        """
        df, parts = self._chunks()
        states = self._states(df, parts, lift, combine, columns, kind)
        return states.fold_with(lambda acc, r: combine(acc, r[0]), zero, ["_state"], kind, name)

    def scan_by(self, lift: Callable[[tuple], Any], combine: Callable[[Any, Any], Any], zero: Any, columns: list[str], kind: str, name: str = "scanned") -> OrderedFrame:
        """zero, then fold_by() up to each row; the order is pos, -1 for zero.

        A prefix scan in two passes: chunks are folded, the states before each chunk (a row a
        chunk) are scanned, and each chunk is scanned from there, by as many tasks.
        """
        df, parts = self._chunks()
        kinds = dict(df.dtypes)
        needed = list(dict.fromkeys([*parts, POS, *columns]))
        df = settled(df.select(*needed))  # read twice
        before = self._states(df, parts, lift, combine, columns, kind)._carries(combine, zero, kind)
        # the state before a chunk comes as its first row
        first = before.select(*parts, F.lit(-1).cast("long").alias(POS), *(F.lit(None).cast(kinds[c]).alias(c) for c in columns if c not in (*parts, POS)), F.col("_state").alias("_before"))
        rows = df.withColumn("_before", F.lit(None).cast(kind)).unionByName(first)

        def step(rows):
            acc = None
            for *r, pos, chunk, carry in rows:
                if pos < 0:
                    acc = carry
                    if not chunk:  # a stream's first
                        yield -1, acc
                else:
                    acc = combine(acc, lift(tuple(r)))
                    yield pos, acc

        chunks = replace(self, df=rows, order=(POS,), by=tuple(parts), levels=None)
        found = chunks._in_order(step, [*columns, POS, CHUNK, "_before"], f"{PLACE} long, `{name}` {kind}", empty=False).drop(CHUNK)
        if not self.by:
            alone = self.spark.createDataFrame([(-1, zero)], f"{PLACE} long, `{name}` {kind}")
            found = found.unionByName(alone.where(~self.df.limit(1).select(F.lit(1)).exists()))
        return self.within(found, (PLACE,)).grown()

    def _carries(self, combine: Callable, zero: Any, kind: str) -> DataFrame:
        """For each chunk's row (CHUNK, _state), what all before it come to, from zero."""

        def step(rows):
            acc = zero
            for chunk, state in rows:
                yield chunk, acc
                acc = combine(acc, state)

        return self._in_order(step, [CHUNK, "_state"], f"{CHUNK} long, _state {kind}", empty=False)

    def mk_string(self, value: Column, sep: str = "", start: str = "", end: str = "", name: str = "text") -> DataFrame:
        """One row (for each key): the values as text, in order."""
        df = positions.with_positions(self)
        joined = F.array_join(in_order(F.col(POS), value.cast("string")), sep)
        return df.groupBy(*self.by).agg(F.concat(F.lit(start), F.coalesce(joined, F.lit("")), F.lit(end)).alias(name))

    def digest(self, value: Column, algorithm: str, name: str = "digest") -> DataFrame:
        """One row (for each key): hexadecimal digest of all values, as bytes, in order."""

        def step(rows):
            h = hasher(algorithm)
            for (x,) in rows:
                if x is not None:
                    h.update(bytes(x))
            yield (h.hexdigest(),)

        return self.with_df(self.df.withColumn("_bytes", value.cast("binary")))._in_order(step, ["_bytes"], f"`{name}` string")
