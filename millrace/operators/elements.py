"""Operators on single elements, and those that need only a row's neighbours."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace import positions

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


class Elements:
    def map(self, **columns: Column) -> OrderedFrame:
        """The order and keys, and the given columns in place of all others."""
        return self.with_df(self.df.select(*self.by, *(c for c in self.order if c not in self.by and c not in columns), *(c.alias(n) for n, c in columns.items())))

    def with_columns(self, **columns: Column) -> OrderedFrame:
        return self.with_df(self.df.withColumns(columns))

    def collect_where(self, where: Column, **columns: Column) -> OrderedFrame:
        """map() of the rows where the condition holds."""
        return self.filter(where).map(**columns)

    def filter(self, where: Column) -> OrderedFrame:
        """Rows where the condition is true (not null)."""
        return self.with_df(self.df.where(where))

    def filter_not(self, where: Column) -> OrderedFrame:
        """Rows where the condition is false (not null)."""
        return self.with_df(self.df.where(~where))

    def filter_type(self, column: str, kind: str) -> OrderedFrame:
        """Rows whose column can be read as kind, and the column as such."""
        return self.with_df(self.df.withColumn(column, F.expr(f"try_cast(`{column}` as {kind})")).where(F.col(column).isNotNull()))

    def flat_map(self, array: Column, name: str, index: str = "idx") -> OrderedFrame:
        """An element for each element of array, in place; index (index_2 and so on where it is taken) joins the order."""
        index = positions.free(index, self.df.columns)
        if name in (*self.order, *self.by):
            raise ValueError(f"{name} is a column of the order or a key")
        df = self.df.select(*(c for c in self.df.columns if c != name), F.posexplode(array).alias(index, name))
        return self.within(df, (*self.order, index)).grown()

    def multiply(self, factor: int, index: str = "idx") -> OrderedFrame:
        """Each element factor times in its place."""
        if factor < 0:
            raise ValueError("factor >= 0")
        times = F.sequence(F.lit(0), F.lit(factor - 1)) if factor else F.array().cast("array<int>")
        index = positions.free(index, self.df.columns)
        return self.within(self.df.withColumn(index, F.explode(times)), (*self.order, index)).grown()

    def duplicate(self) -> OrderedFrame:
        return self.multiply(2)

    def map_async(self, parallelism: int, function: Callable[[dict], dict], schema: str | StructType) -> OrderedFrame:
        """function of each row (a dict), parallelism at a time in a task; the order's columns must stay."""

        def run(batches):
            from concurrent.futures import ThreadPoolExecutor

            import pandas as pd

            with ThreadPoolExecutor(parallelism) as pool:
                for batch in batches:
                    if len(batch):
                        yield pd.DataFrame(list(pool.map(function, batch.to_dict("records"))))

        out = self.with_df(self.df.mapInPandas(run, schema))
        missing = [c for c in (*self.order, *self.by) if c not in out.df.columns]
        if missing:
            raise ValueError(f"the result lacks the order's columns {missing}")
        return out

    #: Order is by columns, so the order of completion makes no difference to rows.
    map_async_unordered = map_async

    def deduplicate(self, *columns: str) -> OrderedFrame:
        """Without elements that equal the one right before (in columns; default: all values)."""
        values = F.struct(*(columns or self.values))
        found = positions.beside(self, back=1, _before=lambda w: F.lag(values).over(w), _first=lambda w: F.lag(F.lit(True)).over(w).isNull())
        return self.with_df(found.where(F.col("_first") | ~same(values, F.col("_before"))).drop(positions.POS, "_before", "_first"))

    def intersperse(self, column: str, inject: Column, start: Column | None = None, end: Column | None = None) -> OrderedFrame:
        """Columns part and column: inject between elements, start before and end after all.

        start and end appear in an empty stream too. The order of the result is its own (place, part).
        """
        if self.by:
            raise ValueError("for a stream without keys")
        kind = self.df.schema[column].dataType
        pos = positions.with_positions(self).select(positions.POS, F.col(column).alias("_x"))
        parts = F.when(F.col(positions.POS) == 0, F.array(F.col("_x"))).otherwise(F.array(inject.cast(kind), F.col("_x")))
        body = pos.select(F.col(positions.POS).alias("place"), F.posexplode(parts).alias("part", column))
        one = self.spark.range(1)
        ends = [one.select(F.lit(p).cast("long").alias("place"), F.lit(0).alias("part"), v.cast(kind).alias(column)) for p, v in ((-1, start), (2**62, end)) if v is not None]
        return type(self)(functools.reduce(lambda a, b: a.unionByName(b), [body, *ends]), ("place", "part"))

    def identity(self) -> OrderedFrame:
        return self

    nop = identity
    #: A buffer that loses nothing, and a choice of threads, make no difference to rows.
    buffer = async_ = lambda self, *_, **__: self

    def async_boundary(self, partitions: int | None = None) -> OrderedFrame:
        """An exchange between what is before and after."""
        keys = [F.col(c) for c in self.by]
        return self.with_df(self.df.repartition(*([partitions] if partitions else []), *keys) if partitions or keys else self.df.repartition())

    def via(self, pipe: Callable[[OrderedFrame], OrderedFrame]) -> OrderedFrame:
        return pipe(self)

    def named(self, name: str) -> OrderedFrame:
        return self.with_df(self.df.alias(name))

    def render(self, mode: str = "formatted") -> str:
        """The plan as text."""
        return self.spark._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), mode)
