"""Operators over streaming DataFrames.

A stream has no total order, so positional operators work on each key, in the order of its
event time: a step sorts what a micro-batch brings for a key, and keeps state between
batches. Rows that come in a later batch with an earlier time go after what was emitted.
Operators on single elements are the DataFrame's own; rates are set at sources
(rowsPerSecond, maxFilesPerTrigger, maxOffsetsPerTrigger).

What ends with time (a group, a silence, a delay) is a timer of event time: it goes off when
the watermark has passed it, so nothing that would change the result can still come, and a
key's state ends with its last timer. Two streams meet as one of tagged rows, with the longer
side's rows in the state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BinaryType, IntegralType, StructField, StructType

#: The state store that transformWithState needs.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Each batch writes what has changed of a partition's state, not the whole store's files.
CHANGELOG = ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")

#: Values of the state store that hold all keys' states.
BUCKETS = 4096
#: Partitions of the state that a replay has at most, or two for each core: a partition costs a
#: store, a worker and a commit in each micro-batch, however few its rows, and a task holds a
#: bucket's rows at a time, however many its partition has.
STATE_PARTITIONS = 32
#: The column of event time in microseconds.
AT = "_at"


class _Buckets(StatefulProcessor):
    """Steps the rows of a bucket of keys in order, with the states of all its keys kept as one value.

    A call of the state store costs milliseconds, whatever it carries, and a key's rows of a
    micro-batch are few: so a bucket's keys share their calls.
    """

    def __init__(self, keys: list[str], kinds: dict[str, str], order: list[str], columns: list[str], names: list[str], step: Callable):
        self.keys, self.kinds, self.order, self.columns, self.names, self.step = keys, kinds, order, columns, names, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("bytes", BinaryType())]))

    def _held(self, empty: Any) -> Any:
        import pickle

        return pickle.loads(self.state.get()[0]) if self.state.exists() else empty

    def _keep(self, held: Any) -> None:
        import pickle

        self.state.update((pickle.dumps(held, protocol=pickle.HIGHEST_PROTOCOL),))

    def _rows(self, rows: Iterator) -> Iterator[tuple[tuple, tuple]]:
        """The key and the columns of each row, in order."""
        import pandas as pd

        batch = pd.concat(list(rows))
        named = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*self.keys, *self.order, *self.columns]))}
        null = {c: f"null_{x}" for c, x in named.items() if f"null_{x}" in batch}
        batch = batch.sort_values([x for c in self.order for x in (*([null[c]] if c in null else []), named[c])], kind="stable")

        def values(c: str) -> list:
            found = batch[named[c]].tolist()
            if c in null and (none := batch[null[c]].to_numpy(bool)).any():
                found = [None if n else v for v, n in zip(found, none, strict=True)]
            return found

        of = {c: values(c) for c in dict.fromkeys([*self.keys, *self.columns])}
        # NaN is one key, as for Spark
        keys = [["NaN" if v != v else v for v in of[k]] if self.kinds[k] in ("float", "double") else of[k] for k in self.keys]
        return zip(zip(*keys, strict=True), zip(*(of[c] for c in self.columns), strict=True) if self.columns else ((),) * len(batch), strict=True)

    def _frame(self, rows: list) -> Any:
        import pandas as pd

        made = pd.DataFrame(rows, columns=[*self.keys, *self.names], dtype=object)
        for k in self.keys:
            if self.kinds[k] in ("float", "double"):
                made[k] = [float("nan") if v == "NaN" else v for v in made[k]]
        return made

    def close(self) -> None:
        pass


class _Stepper(_Buckets):
    """step(state, row) -> (state, rows) for each key, from initial."""

    def __init__(self, *shape: Any, initial: Any):
        super().__init__(*shape)
        self.initial = initial

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:
        import pickle

        held, first, out = self._held({}), pickle.dumps(self.initial), []
        for k, r in self._rows(rows):
            state, emitted = self.step(held[k] if k in held else pickle.loads(first), r)  # a step may change its state in place
            held[k] = state
            out += [(*k, *e) for e in emitted]
        self._keep(held)
        yield self._frame(out)


def _bucketed(df: DataFrame, keys: list[str], order: list[str], columns: list[str], buckets: int) -> Any:
    """df's needed columns, as c0, c1 and so on, by buckets of keys.

    Beside whole numbers and keys that may be null stands whether they are: pandas would make
    such numbers doubles. It would also change names that aren't Python's.
    """
    fields, out = {f.name: f for f in df.schema.fields}, []
    for i, c in enumerate(dict.fromkeys([*keys, *order, *columns])):
        number = isinstance(fields[c].dataType, IntegralType)
        flagged = fields[c].nullable and (number or c in keys)
        out.append((F.coalesce(F.col(c), F.lit(0).cast(fields[c].dataType)) if flagged and number else F.col(c)).alias(f"c{i}"))
        if flagged:
            out.append(F.col(c).isNull().alias(f"null_c{i}"))
    return df.select(*out, F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")).groupBy("bucket")


def stepped(df: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, initial: Any, step: Callable[[Any, tuple], tuple[Any, list[tuple]]], buckets: int = BUCKETS) -> DataFrame:
    """The keys and what step(state, row) -> (state, rows of schema) emits for each row (a tuple of columns), key by key in order.

    buckets: how many values of the state store hold the keys' states; it can't change while a stream's checkpoint is used.
    """
    kinds = dict(df.dtypes)
    names = StructType.fromDDL(schema).names
    whole = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [schema])
    return _bucketed(df, keys, order, columns, buckets).transformWithStateInPandas(_Stepper(keys, kinds, order, columns, names, step, initial=initial), whole, "Append", "None")


class _Timed(_Buckets):
    """As _Stepper, with timers: a key's state is (due, own), and at due (milliseconds) expire(own, watermark) -> (state, rows); a state of None ends.

    A bucket has one timer, for the first of its keys that is due; all that are due go with it.
    """

    def __init__(self, *shape: Any, expire: Callable):
        super().__init__(*shape)
        self.expire = expire

    def _put(self, was: int | None, held: dict) -> None:
        due = min((s[0] for s in held.values() if s[0] is not None), default=None)
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        if held:
            self._keep((due, held))
        else:
            self.state.clear()

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:
        was, held = self._held((None, {}))
        out: list = []
        for k, r in self._rows(rows):
            state = held.get(k)
            state, emitted = self.step(state[1] if state else None, r)
            if state is None:
                held.pop(k, None)
            else:
                held[k] = state
            out += [(*k, *e) for e in emitted]
        self._put(was, held)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator:
        (was, held), at = self._held((None, {})), expiredTimerInfo.getExpiryTimeInMs()
        out: list = []
        if was == at:
            watermark = timerValues.getCurrentWatermarkInMs()
            for k in [k for k, s in held.items() if s[0] is not None and s[0] <= max(at, watermark)]:
                state, emitted = self.expire(held.pop(k)[1], watermark)
                if state is not None:
                    held[k] = state
                out += [(*k, *e) for e in emitted]
            self._put(None, held)  # the timer that went off goes by itself
        yield self._frame(out)


def timed(df: DataFrame, keys: list[str], order: list[str], ts: str, late: str, columns: list[str], schema: str, step: Callable, expire: Callable, buckets: int = BUCKETS) -> DataFrame:
    """What step(own state or None, row) -> ((due, own) or None, rows) emits for each row, and expire(own, watermark) -> the same where due has passed.

    ts is the column of event time, of which rows come at most late after others; a column AT has
    it in microseconds, and columns that are times come as pandas has them. due is in milliseconds;
    buckets is as in stepped().
    """
    df = df.withWatermark(ts, late).withColumn(AT, F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**63) // 1000)))
    kinds = dict(df.dtypes)
    names = StructType.fromDDL(schema).names
    whole = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [schema])
    order = [AT if c == ts else c for c in order]
    # ts goes along: by it Spark leaves out what comes too late
    return _bucketed(df, keys, order, [*columns, ts], buckets).transformWithStateInPandas(_Timed(keys, kinds, order, columns, names, step, expire=expire), whole, "Append", "EventTime")


def grouped_within(df: DataFrame, keys: list[str], order: list[str], ts: str, late: str, value: str, most: int, micros: int, name: str = "group") -> DataFrame:
    """Arrays of the key's values: a group ends with most values, or micros after its first, when the watermark has passed that or a later row comes."""
    kind = dict(df.dtypes)[value]
    due = lambda began: -(-(began + micros) // 1000)

    def step(own, row):
        n, began, held = own or (0, 0, [])
        (t, v), out = row, []
        if held and t - began >= micros:
            out.append((n, began, held))
            n, held = n + 1, []
        began = began if held else t
        held.append(v)
        if len(held) == most:
            out.append((n, began, held))
            n, held = n + 1, []
        return (due(began) if held else None, (n, began, held)), out

    def expire(own, watermark):
        n, began, held = own
        return (None, (n + 1, began, [])), [(n, began, held)]  # the next group's number stays

    return timed(df, keys, order, ts, late, [AT, value], f"group_id long, started long, `{name}` array<{kind}>", step, expire)


def idle(df: DataFrame, keys: list[str], order: list[str], ts: str, late: str, micros: int) -> DataFrame:
    """since and n for each silence of a key of micros or more: its last row's time (microseconds), and the rows since the silence before. A key's state ends with it."""

    def step(own, row):
        last, n = own or (None, 0)
        t, out = row[0], []
        if n and t - last >= micros:
            out, n = [(last, n)], 0
        return (-(-(t + micros) // 1000), (t, n + 1)), out

    def expire(own, watermark):
        return None, [own]

    return timed(df, keys, order, ts, late, [AT], "since long, n long", step, expire)


def delay(df: DataFrame, keys: list[str], order: list[str], ts: str, late: str, micros: int, columns: list[str]) -> DataFrame:
    """Each row of the key once the watermark has passed its time by micros, and left: when it does (microseconds), a row of the key after the other.

    A row leaves micros after it came, or after the one before left.
    """
    kinds = dict(df.dtypes)

    def step(own, row):
        last, held = own or (None, [])
        t = row[0]
        left = max(t, last if last is not None else t) + micros
        held.append((*row[1:], left))
        return (-(-held[0][-1] // 1000), (left, held)), []

    def expire(own, watermark):
        last, held = own
        n = bisect_right(held, watermark * 1000, key=lambda r: r[-1]) or 1  # they leave one after the other
        rest = held[n:]
        return ((-(-rest[0][-1] // 1000), (last, rest)) if rest else None), held[:n]

    return timed(df, keys, order, ts, late, [AT, *columns], ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["left long"]), step, expire)


def tagged(left: DataFrame, right: DataFrame, keys: list[str], order: str, ts: str, value: str) -> DataFrame:
    """Both streams' keys, order, ts and value (of the same kinds in both) as one, with src (0 or 1)."""
    some = list(dict.fromkeys([*keys, order, ts, value]))
    return left.select(*some, F.lit(0).alias("src")).unionByName(right.select(*some, F.lit(1).alias("src")))


def zipped(left: DataFrame, right: DataFrame, keys: list[str], order: str, ts: str, value: str) -> DataFrame:
    """pos and the values left and right of the same position of the key's rows in both; what one has more waits in the state."""
    kind = dict(left.dtypes)[value]

    def step(own, row):
        n, waiting = own
        src, v = row
        waiting[src].append(v)
        if waiting[0] and waiting[1]:
            return (n + 1, waiting), [(n, *(w.popleft() for w in waiting))]
        return own, []

    whole = tagged(left, right, keys, order, ts, value)
    return stepped(whole, keys, [order], ["src", value], f"pos long, `left` {kind}, `right` {kind}", (0, (deque(), deque())), step)


def interleaved(left: DataFrame, right: DataFrame, keys: list[str], order: str, ts: str, value: str, segment: int = 1) -> DataFrame:
    """pos, src and value of segment rows of each side in turn; what comes before its turn waits in the state."""
    kind = dict(left.dtypes)[value]

    def step(own, row):
        n, waiting = own
        src, v = row
        out = []
        waiting[src].append(v)
        while waiting[turn := n // segment % 2]:
            out.append((n, turn, waiting[turn].popleft()))
            n += 1
        return (n, waiting), out

    whole = tagged(left, right, keys, order, ts, value)
    return stepped(whole, keys, [order], ["src", value], f"pos long, src int, `{value}` {kind}", (0, (deque(), deque())), step)


def merged_sorted(left: DataFrame, right: DataFrame, keys: list[str], order: str, ts: str, late: str, value: str) -> DataFrame:
    """pos, src and value of the key's rows of both by ts, then side, then order: each is let go when the watermark has passed its ts."""
    kind = dict(left.dtypes)[value]
    due = lambda t: t // 1000 + 1

    def step(own, row):
        n, first, held = own or (0, row[0], [])
        first = min(first, row[0])
        held.append(row)
        return (due(first), (n, first, held)), []

    def expire(own, watermark):
        n, _, held = own
        held.sort()
        k = bisect_left(held, watermark * 1000, key=lambda h: h[0])
        out = [(n + i, h[1], h[3]) for i, h in enumerate(held[:k])]
        rest = held[k:]
        return (due(rest[0][0]), (n + k, rest[0][0], rest)) if rest else (None, (n + k, float("inf"), [])), out

    whole = tagged(left, right, keys, order, ts, value)
    return timed(whole, keys, [ts, "src", order], ts, late, [AT, "src", order, value], f"pos long, src int, `{value}` {kind}", step, expire)


def replayed(df: DataFrame, ts: str, batches: int, path: str) -> DataFrame:
    """df as a stream of so many micro-batches, by ranges of ts: files written to path, of each batch as many as fit CHUNK_ROWS rows a file."""
    from millrace.positions import CHUNK_ROWS

    spark = df.sparkSession
    cuts = F.percentile_approx(ts, [i / batches for i in range(1, batches)]) if batches > 1 else F.array().cast("array<int>")
    n, bounds = df.agg(F.count("*"), cuts).first()
    files = max(1, -(-n // (batches * CHUNK_ROWS)))
    edges = [None, *sorted(set(bounds or [])), None]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        where = (F.lit(True) if a is None else F.col(ts) > a) & (F.lit(True) if b is None else F.col(ts) <= b)
        own, at = df.where(where), f"{path}/batch={i:04d}"
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.parquet(at)
        if files > 1:
            # a micro-batch takes as many files, so each batch must have them
            folder = spark._jvm.org.apache.hadoop.fs.Path(at)
            found = [x.getPath().getName() for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
            if (made := sum(x.startswith("part-") for x in found)) != files:
                raise RuntimeError(f"{made} files of a batch, not {files}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def played(df: DataFrame, name: str, timeout_s: int | None = None) -> DataFrame:
    """What a stream comes to when all that is there has been processed, as a table in the shared folder; however long that takes, unless timeout_s is given."""
    from millrace.session import shared_path

    spark, shuffled = df.sparkSession, "spark.sql.shuffle.partitions"
    partitions = min(int(spark.conf.get(shuffled)), max(STATE_PARTITIONS, 2 * spark.sparkContext.defaultParallelism))
    own = dict([ROCKSDB, CHANGELOG, (shuffled, str(partitions))])
    held = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        out = shared_path(spark, name)
        finished(df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start(), timeout_s)
        return spark.read.schema(df.schema).parquet(out)
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _with(df: DataFrame, columns: list[str], extra: str = "") -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ([extra] if extra else []))


def deduplicate(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Without rows whose values equal those of the key's row before."""
    columns = list(dict.fromkeys([*order, *values]))
    at = [columns.index(v) for v in values]

    def step(before, row):
        own = [row[i] for i in at]
        return own, [] if own == before else [row]

    return stepped(df, keys, order, columns, _with(df, columns), None, step)


def scan(df: DataFrame, keys: list[str], order: list[str], value: str, zero: Any, function: Callable[[Any, Any], Any], kind: str, name: str = "scanned") -> DataFrame:
    """function(so far, value) after each row of the key."""
    columns = list(dict.fromkeys([*order, value]))
    at = columns.index(value)

    def step(acc, row):
        acc = function(acc, row[at])
        return acc, [(*row, acc)]

    return stepped(df, keys, order, columns, _with(df, columns, f"`{name}` {kind}"), zero, step)


def grouped(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, name: str = "group") -> DataFrame:
    """Arrays of size values of the key; what is left stays in the state."""
    kind = dict(df.dtypes)[value]

    def step(state, row):
        number, held = state
        held = [*held, row[0]]
        return ((number + 1, []), [(number, held)]) if len(held) == size else ((number, held), [])

    return stepped(df, keys, order, [value], f"group_id long, `{name}` array<{kind}>", (0, []), step)


def sliding(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, name: str = "window") -> DataFrame:
    """Arrays of the key's last size values, once there are so many."""
    kind = dict(df.dtypes)[value]

    def step(state, row):
        number, held = state
        held = [*held, row[0]][-size:]
        return (number + 1, held), [(number - size + 1, held)] if len(held) == size else []

    return stepped(df, keys, order, [value], f"pos long, `{name}` array<{kind}>", (0, []), step)


def take(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    columns = [c for c in df.columns if c not in keys]
    return stepped(df, keys, order, columns, _with(df, columns), 0, lambda seen, row: (seen + 1, [row] if seen < n else []))


def split_when(df: DataFrame, keys: list[str], order: list[str], starts: str) -> DataFrame:
    """group_id: the number of the key's sub-stream; a row with a true starts begins a new one."""
    columns = [c for c in df.columns if c not in keys]
    at = columns.index(starts)

    def step(group, row):
        group = 0 if group is None else group + bool(row[at])
        return group, [(*row, group)]

    return stepped(df, keys, order, columns, _with(df, columns, "group_id long"), None, step)


def conflate(df: DataFrame, ts: str, window: str, late: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """A row for each window of event time and key with its aggregates, once the watermark (late behind) has passed it."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(*(a.alias(n) for n, a in aggregates.items())).select(F.col("window.start").alias("started"), *keys, *aggregates)


def sample(df: DataFrame, ts: str, window: str, late: str, keys: list[str]) -> DataFrame:
    """The last row of each window."""
    return conflate(df, ts, window, late, keys, row=F.max_by(F.struct(*df.columns), ts)).select("row.*")


def sessions(df: DataFrame, ts: str, gap: str, late: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """A row for each session: rows of a key that are less than gap apart."""
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*(a.alias(n) for n, a in aggregates.items())).select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), *keys, *aggregates)


def tee(df: DataFrame, checkpoint: str, *drains: Callable[[DataFrame, int], Any]) -> StreamingQuery:
    """Each micro-batch to each drain, computed once."""

    def all_of(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for drain in drains:
                drain(batch, number)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(all_of).option("checkpointLocation", checkpoint).start()


def finished(query: StreamingQuery, timeout_s: int | None) -> None:
    """Waits for all that is there to be processed; an error if that takes longer (a completion timeout)."""
    if timeout_s is None:
        query.awaitTermination()
        return
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"not complete after {timeout_s} s")
