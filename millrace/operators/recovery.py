"""Errors as data, and hooks.

A failing expression fails the whole Spark job, so errors are modelled first: ok is a
condition (as from try_cast) that is false where an element fails. Of a function, whose errors
no condition tells beforehand, try_map() has the tasks catch what it raises, row by row; the
first place at which it does is found over all tasks, and what comes after is cut off.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from millrace.operators.cycles import settled
from millrace.positions import free

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame

log = logging.getLogger(__name__)


class Recovery:
    def recover_with(self, ok: Column, *fallbacks: OrderedFrame) -> OrderedFrame:
        """The rows before the first that fails, then the first fallback if one fails; likewise for the fallbacks' own rows.

        Frames have the same columns; ok is evaluated on each. With no fallback left, the job fails.
        """
        if self.by:
            raise ValueError("for a stream without keys")
        if not fallbacks:
            fails = F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("an element failed, and no recovery is left")).cast("boolean"))
            return type(self)(self.df.where(fails).withColumn("src", F.lit(0)), ("src", *self.order))
        failed = self.df.where(~F.coalesce(ok, F.lit(False))).select(F.lit(1)).exists()
        head = self.take_while(ok).df.withColumn("src", F.lit(0))
        rest = fallbacks[0].recover_with(ok, *fallbacks[1:])
        return type(self)(head.unionByName(rest.df.where(failed).withColumn("src", F.col("src") + 1)), ("src", *self.order))

    def recover(self, ok: Column, fallback: OrderedFrame) -> OrderedFrame:
        """recover_with() a fallback that can't fail (one element, as a rule)."""
        failed = self.df.where(~F.coalesce(ok, F.lit(False))).select(F.lit(1)).exists()
        head = self.take_while(ok).df.withColumn("src", F.lit(0))
        return type(self)(head.unionByName(fallback.df.where(failed).withColumn("src", F.lit(1))), ("src", *self.order))

    def recover_to_try(self, value: Column, ok: Column, error: Column, name: str = "result") -> OrderedFrame:
        """Structs (ok, value, error) for the rows up to the first that fails, which is the last."""
        good = F.coalesce(ok, F.lit(False))
        failing = self.df.where(~good).agg(F.min(F.struct(*self.order))).scalar()
        key = F.struct(*self.order)
        df = self.df.withColumn("_end", failing)
        df = df.where(F.col("_end").isNull() | (key <= F.col("_end"))).drop("_end")
        result = F.struct(good.alias("ok"), F.when(good, value).alias("value"), F.when(~good, error).alias("error"))
        return self.with_df(df.select(*self.by, *self.order, result.alias(name)))

    def try_map(self, function: Callable[[tuple], Any], columns: list[str], kind: str, name: str = "value") -> OrderedFrame:
        """The order and keys, name: function of each row (a tuple of columns), and ok, error_type and error: whether it raised, and what.

        Rows are computed once: what reads the result doesn't call function again.
        """
        kept = list(dict.fromkeys([*self.by, *self.order]))
        if set(kept) & {name, "ok", "error_type", "error"}:
            raise ValueError(f"{name}, ok, error_type and error are columns of the result")
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        kinds = dict(self.df.dtypes)
        schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{name}` {kind}", "ok boolean, error_type string, error string"])

        made = to_arrow_schema(StructType.fromDDL(schema))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                found = []
                for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True) if columns else [()] * len(batch):
                    try:
                        found.append((function(row), True, None, None))
                    except Exception as e:
                        found.append((None, False, type(e).__name__, str(e)))
                made_of = zip(*found, strict=True) if found else [()] * 4
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, f.type) for c, f in zip(made_of, list(made)[len(kept) :], strict=True))], schema=made)

        rows = self.df.select(*dict.fromkeys([*kept, *columns])).mapInArrow(run, schema)
        return self.with_df(settled(rows))

    def _upto_error(self) -> DataFrame:
        """The rows of a tried frame up to the first that raised (of each key), which is the last."""
        failed = ~F.col("ok")
        if self.by:
            before = self.window().rowsBetween(Window.unboundedPreceding, -1)
            return self.df.withColumn("_failed", F.coalesce(F.max(failed).over(before), F.lit(False))).where(~F.col("_failed")).drop("_failed")
        key = F.struct(*self.order)
        first = self.df.withColumn("_end", self.df.where(failed).agg(F.min(key)).scalar())
        return first.where(F.col("_end").isNull() | (key <= F.col("_end"))).drop("_end")

    def raised_to_try(self, name: str = "result") -> OrderedFrame:
        """Of a tried frame: structs (ok, value, error_type, error) up to the first row that raised, which is the last."""
        whole = F.struct("ok", *(F.col(c) for c in self.values if c not in ("ok", "error_type", "error")), "error_type", "error")
        return self.with_df(self._upto_error().select(*dict.fromkeys([*self.by, *self.order]), whole.alias(name)))

    def recover_raised(self, *fallbacks: OrderedFrame, errors: tuple[str, ...] | None = None) -> OrderedFrame:
        """Of a tried frame: the rows before the first that raised, then the first fallback if one did; likewise for a fallback that was tried.

        Frames have the same columns beside ok and the errors. Errors other than errors (names
        of classes; None: all are handled), and those for which no fallback is left, fail the
        job with what was raised.
        """
        if self.by:
            raise ValueError("for a stream without keys")
        tried = "ok" in self.df.columns
        handled = F.lit(bool(fallbacks)) if errors is None else F.col("error_type").isin(*errors) & F.lit(bool(fallbacks))
        src = free("src", [c for f in (self, *fallbacks) for c in f.df.columns])
        head = self.df
        if tried:
            fails = F.raise_error(F.concat_ws(": ", "error_type", "error")).cast("boolean")
            head = self._upto_error().where(F.when(F.col("ok"), F.lit(True)).when(handled, F.lit(False)).otherwise(fails)).drop("ok", "error_type", "error")
        head = head.withColumn(src, F.lit(0))
        if not tried or not fallbacks:
            return self.within(head, (src, *self.order))
        failed = self.df.where(~F.col("ok")).select(F.lit(1)).exists()
        rest = fallbacks[0].recover_raised(*fallbacks[1:], errors=errors)
        own = rest.df.withColumn(src, F.col(rest.order[0]) + 1) if rest.order[0] == src else rest.df.withColumn(src, F.col(rest.order[0]) + 1).drop(rest.order[0])
        return self.within(head.unionByName(own.where(failed)), (src, *self.order)).grown()

    def on_element(self, function: Callable[[dict], Any]) -> OrderedFrame:
        """function of each row (a dict), in the tasks, as rows go by."""

        def tap(batches):
            for batch in batches:
                for r in batch.to_dict("records"):
                    function(r)
                yield batch

        return self.with_df(self.df.mapInPandas(tap, self.df.schema))

    def on_signal(self, name: str, *metrics: Column) -> tuple[OrderedFrame, Observation]:
        """The frame, observed: the observation has the number of elements and the metrics after an action."""
        seen = Observation(name)
        return self.with_df(self.df.observe(seen, F.count(F.lit(1)).alias("elements"), *metrics)), seen

    def log_signal(self, marker: str) -> OrderedFrame:
        return self.on_element(lambda r: log.info("%s: %s", marker, r))

    def run(self, action: Callable[[DataFrame], Any], on_start: Callable[[], Any] | None = None, on_complete: Callable[[], Any] | None = None, on_error: Callable[[Exception], Any] | None = None, on_terminate: Callable[[Exception | None], Any] | None = None) -> Any:
        """action of the rows in order, with hooks in the driver around it; an error is raised again."""
        if on_start:
            on_start()
        try:
            result = action(self.sorted())
        except Exception as e:
            if on_error:
                on_error(e)
            if on_terminate:
                on_terminate(e)
            raise
        if on_complete:
            on_complete()
        if on_terminate:
            on_terminate(None)
        return result

    def protect(self, action: Callable[[DataFrame], Any], attempts: int = 3) -> Any:
        """action of the rows in order, tried again after an error, attempts times in all."""
        for left in range(attempts - 1, -1, -1):
            try:
                return action(self.sorted())
            except Exception:
                if not left:
                    raise
                log.warning("failed, tried again", exc_info=True)
        raise ValueError("attempts >= 1")
