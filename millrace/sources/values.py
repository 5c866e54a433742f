"""Streams of values. An infinite stream needs a bound: count, the number of its elements."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import Future
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.frame import OrderedFrame
from millrace.positions import PLACE


def _numbered(spark: SparkSession, count: int, value: Column) -> OrderedFrame:
    return OrderedFrame.of(spark.range(count).select(F.col("id").alias(PLACE), value.alias("value")), PLACE)


def from_iterable(spark: SparkSession, values: Iterable, kind: str) -> OrderedFrame:
    rows = [(i, v) for i, v in enumerate(values)]
    return OrderedFrame.of(spark.createDataFrame(rows, f"{PLACE} long, value {kind}"), PLACE)


from_iterator = from_iterable


def of(spark: SparkSession, kind: str, *values: Any) -> OrderedFrame:
    return from_iterable(spark, values, kind)


def one(spark: SparkSession, value: Any, kind: str) -> OrderedFrame:
    return of(spark, kind, value)


def empty(spark: SparkSession, kind: str) -> OrderedFrame:
    return of(spark, kind)


def empty_from(spark: SparkSession, future: Future, kind: str) -> OrderedFrame:
    """No element, once the future is done; its error if it has one."""
    future.result()
    return empty(spark, kind)


def failing(spark: SparkSession, error: Exception, kind: str, eager: bool = True) -> OrderedFrame:
    """The error now, or when the stream runs."""
    if eager:
        raise error
    return _numbered(spark, 1, F.raise_error(F.lit(str(error))).cast(kind))


def from_option(spark: SparkSession, value: Any | None, kind: str) -> OrderedFrame:
    return of(spark, kind, *([] if value is None else [value]))


def from_future(spark: SparkSession, future: Future, kind: str) -> OrderedFrame:
    return from_option(spark, future.result(), kind)


def from_try(spark: SparkSession, value: Any | Exception, kind: str) -> OrderedFrame:
    return failing(spark, value, kind) if isinstance(value, Exception) else one(spark, value, kind)


def ints(spark: SparkSession, start: int, step: int = 1, *, count: int) -> OrderedFrame:
    return _numbered(spark, count, (F.lit(start) + F.col("id") * step).cast("int"))


def longs(spark: SparkSession, start: int, step: int = 1, *, count: int) -> OrderedFrame:
    return _numbered(spark, count, F.lit(start).cast("long") + F.col("id") * step)


def doubles(spark: SparkSession, start: float, step: float, *, count: int) -> OrderedFrame:
    """start + n * step: rounded once, where adding step again and again rounds each time."""
    return _numbered(spark, count, F.lit(float(start)) + F.col("id") * float(step))


def repeat(spark: SparkSession, value: Any, *, count: int) -> OrderedFrame:
    return _numbered(spark, count, F.lit(value))


def continually(spark: SparkSession, value: Column, *, count: int) -> OrderedFrame:
    """The expression evaluated anew for each element."""
    return _numbered(spark, count, value)


def tick(spark: SparkSession, value: Any, start: str, interval: str, *, count: int, elements: int = 1) -> OrderedFrame:
    """elements a interval: value and at, its time from start on."""
    at = F.lit(start).cast("timestamp") + F.floor(F.col("id") / elements).cast("int") * F.expr(f"interval {interval}")
    return OrderedFrame.of(spark.range(count).select(F.col("id").alias(PLACE), F.lit(value).alias("value"), at.alias("at")), PLACE)


def rate(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """A streaming source of timestamp and value."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def unfold(spark: SparkSession, state: Any, step: Callable[[Any], tuple | None], kind: str, most: int = 1_000_000) -> OrderedFrame:
    """Elements of step(state): None ends, (element, None) is the last, (element, next state) goes on.

    Each state needs the one before, so one task makes all; most bounds their number, and
    the job fails beyond it.
    """

    def run(batches):
        import pandas as pd

        for _ in batches:
            pass
        at, n, held = state, 0, []
        while (found := step(at)) is not None:
            if n >= most:
                raise RuntimeError(f"more than {most} elements")
            held.append((n, found[0]))
            n += 1
            if len(held) == 10_000:
                yield pd.DataFrame(held, columns=[PLACE, "value"])
                held = []
            if found[1] is None:
                break
            at = found[1]
        yield pd.DataFrame(held, columns=[PLACE, "value"])

    return OrderedFrame.of(spark.range(0, 1, 1, 1).mapInPandas(run, f"{PLACE} long, value {kind}"), PLACE)


def unfold_async(spark: SparkSession, state: Any, step: Callable[[Any], Future], kind: str, most: int = 1_000_000) -> OrderedFrame:
    return unfold(spark, state, lambda s: step(s).result(), kind, most)


def iterate(spark: SparkSession, start: Any, function: Callable[[Any], Any], kind: str, *, count: int) -> OrderedFrame:
    """start, function(start) and so on."""

    def step(state: tuple) -> tuple | None:
        i, x = state
        return None if i == count else (x, (i + 1, function(x)) if i + 1 < count else None)

    return unfold(spark, (0, start), step, kind, count)


def lazy_start(make: Callable[[], OrderedFrame]) -> Callable[[], OrderedFrame]:
    """A source that is made once, when it is first asked for."""
    made: list[OrderedFrame] = []

    def get() -> OrderedFrame:
        if not made:
            made.append(make())
        return made[0]

    return get


class Push:
    """Elements pushed by the caller into a bounded buffer, then a frame."""

    def __init__(self, spark: SparkSession, kind: str, most: int = 1024):
        self._spark, self._kind, self._most = spark, kind, most
        self._held: list = []
        self._done: Exception | bool = False

    def offer(self, value: Any) -> bool:
        """Whether there was room."""
        if not self.accepts_next:
            return False
        self._held.append(value)
        return True

    def offer_many(self, values: Iterable) -> int:
        """The number of values taken."""
        taken = 0
        for v in values:
            if not self.offer(v):
                break
            taken += 1
        return taken

    def complete(self) -> None:
        self._done = self._done or True

    def error_complete(self, error: Exception) -> None:
        self._done = self._done or error

    @property
    def queue_size(self) -> int:
        return len(self._held)

    @property
    def accepts_next(self) -> bool:
        return not self._done and len(self._held) < self._most

    def frame(self) -> OrderedFrame:
        """What was pushed, after complete(); the error after error_complete()."""
        if isinstance(self._done, Exception):
            raise self._done
        if not self._done:
            raise RuntimeError("not complete")
        return from_iterable(self._spark, self._held, self._kind)


def source(spark: SparkSession, value: Any, kind: str) -> OrderedFrame:
    """A frame of anything that can be one: a frame, future, error, bytes, function without arguments, iterable or None."""
    if isinstance(value, OrderedFrame):
        return value
    if isinstance(value, Push):
        return value.frame()
    if isinstance(value, Future):
        return from_future(spark, value, kind)
    if value is None or isinstance(value, Exception):
        return from_option(spark, None, kind) if value is None else from_try(spark, value, kind)
    if isinstance(value, bytes | bytearray):
        return from_iterable(spark, [b - 256 if b > 127 else b for b in value], "tinyint")
    if callable(value):
        return source(spark, value(), kind)
    if isinstance(value, Iterable) and not isinstance(value, str):
        return from_iterable(spark, value, kind)
    return one(spark, value, kind)
