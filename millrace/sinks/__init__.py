"""Ends of streams: actions, and files."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

from millrace.operators.slicing import at_least


class StreamLimitExceeded(Exception):
    pass


class NoSuchElement(Exception):
    pass


class Sinks:
    def seq(self, limit: int) -> list[Row]:
        """All rows in order; an error for more than limit."""
        rows = self.sorted().limit(limit + 1).collect()
        if len(rows) > limit:
            raise StreamLimitExceeded(f"more than {limit}")
        return rows

    def first_rows(self, n: int) -> list[Row]:
        """At most n rows, the first."""
        at_least("n", n, 1)
        return self.sorted().limit(n).collect()

    def head_option(self) -> Row | None:
        return next(iter(self.first_rows(1)), None)

    def head(self) -> Row:
        row = self.head_option()
        if row is None:
            raise NoSuchElement("the stream is empty")
        return row

    def last_option(self) -> Row | None:
        keys = [F.col(c).desc() for c in (*self.by, *self.order)]
        return next(iter(self.df.orderBy(*keys).limit(1).collect()), None)

    def last_row(self) -> Row:
        row = self.last_option()
        if row is None:
            raise NoSuchElement("the stream is empty")
        return row

    def ignore(self) -> None:
        """Runs all, keeps nothing."""
        self.df.write.format("noop").mode("overwrite").save()

    def cancelling(self) -> None:
        """Runs nothing."""

    def foreach(self, function: Callable[[Row], Any]) -> None:
        """function of each row in order, in the driver, a partition at a time."""
        for row in self.sorted().toLocalIterator():
            function(row)

    def parallel_foreach(self, parallelism: int, function: Callable[[Row], Any]) -> None:
        """function of each row, in parallelism tasks."""
        self.df.repartition(parallelism).foreach(function)

    def folding(self, how: str, value: Column, zero: Any) -> Any:
        """The value of fold() for a stream without keys."""
        return self.fold(how, value, zero).first()[0]

    def to_mk_string(self, value: Column, limit: int, sep: str = "", start: str = "", end: str = "") -> str:
        """The values as one text; an error for more than limit."""
        rows = self.with_df(self.df.select(*self.by, *self.order, value.cast("string").alias("_text"))).seq(limit)
        return start + sep.join("null" if r["_text"] is None else r["_text"] for r in rows) + end

    def to_file(self, path: str, value: Column, append: bool = False) -> int:
        """Writes the values' bytes in order to one file; the number of bytes.

        Each value's place is the sum of the sizes of those before, so all tasks write at once.
        """
        from millrace import positions
        from millrace.sources.ranges import write_places

        flat = type(self)(self.df, (*self.by, *self.order))  # streams one after the other
        sized = flat.with_df(flat.df.select(*flat.order, value.cast("binary").alias("_bytes")))
        placed = positions.running(sized, inclusive=False, _at=("sum", F.coalesce(F.octet_length("_bytes"), F.lit(0)).cast("long")))
        return write_places(placed.select("_at", "_bytes").sortWithinPartitions("_at"), path, append)

    def to_files(self, path: str, value: str, format: str = "text") -> None:
        """Writes a column in order as a folder of files, each a range of the order."""
        self.df.repartitionByRange(*self.by, *self.order).sortWithinPartitions(*self.by, *self.order).select(value).write.format(format).save(path)


def write_file(path: str, data: bytes | Iterable[int]) -> None:
    with open(path, "wb") as f:
        f.write(bytes(data))


def lazy_drain(make: Callable[[], Callable]) -> Callable:
    """A drain that is made when it gets its frame."""
    return lambda frame: make()(frame)


def map_result(drain: Callable, function: Callable[[Any], Any]) -> Callable:
    """A drain whose result is function of drain's."""
    return lambda frame: function(drain(frame))


def drop_result(drain: Callable) -> Callable:
    return map_result(drain, lambda _: None)


def capture_result(drain: Callable, keep: Callable[[Any], Any]) -> Callable:
    """A drain that also gives its result to keep."""

    def run(frame):
        result = drain(frame)
        keep(result)
        return result

    return run


def contramap(drain: Callable, pipe: Callable) -> Callable:
    """A drain of frames that pipe makes fit for drain."""
    return lambda frame: drain(pipe(frame))
