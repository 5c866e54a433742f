"""Groups of neighbours and sub-streams.

A stream of streams is in long form: rows with a path of key columns, one (or some) a level. A
keyed frame is such a stream. An operator that cuts streams adds a level, whose column is
group_id, or group_id_2 and so on where that is taken; flattening takes the innermost level
away, so streams of streams of streams are flattened one level at a time.
"""

from __future__ import annotations

import functools
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import positions
from millrace.operators.cycles import settled
from millrace.operators.slicing import at_least
from millrace.positions import CHUNK, PLACE, POS, free

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame

EMIT, DROP, EMIT_COMPLETE, COMPLETE_EMIT, DROP_COMPLETE = COMMANDS = ("Emit", "Drop", "EmitComplete", "CompleteEmit", "DropComplete")
GROUP = "group_id"


def in_order(pos: Column, value: Column) -> Column:
    """The array of value by pos, of a grouped frame."""
    return F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), value.alias("v")))), lambda x: x["v"])


def _links(t, most: int, micros: int):
    """A chunk's own positions, its times, and for each of its rows the place (from the chunk's first) of the first of the next group if one begins with it."""
    import numpy as np

    t = t.take(np.argsort(t[POS].to_numpy(), kind="stable"))
    own = int(np.count_nonzero(t["_own"].to_numpy(zero_copy_only=False)))
    times = t["_t"].fill_null(np.iinfo(np.int64).min).to_numpy()
    n = len(times)
    # the first row after each that is micros later: by the greatest times of 1, 2, 4 and so on rows from each
    greatest = [times]
    while 1 << len(greatest) <= min(most, n):
        step, last = 1 << (len(greatest) - 1), greatest[-1]
        greatest.append(np.maximum(last[:-step], last[step:]))
    at, due = np.arange(own) + 1, times[:own] + micros
    for level in range(len(greatest) - 1, -1, -1):
        have = greatest[level]
        inside = at < len(have)
        early = inside & (have[np.minimum(at, len(have) - 1)] < due)
        at = at + np.where(early, 1 << level, 0)
    return t[POS].to_numpy()[:own], times[:own], np.minimum(at, np.arange(own) + most)


def _exits(t, most: int, micros: int):
    """For each place below most at which a chunk's first group may begin: where the next chunk's does, and the position of the chunk's last (-1: none)."""
    import numpy as np
    import pyarrow as pa

    places, _, links = _links(t, most, micros)
    n = len(places)
    end = np.where(links < n, links, np.arange(n))  # the last group's first row, for each one's
    while True:
        further = end[end]
        if (further == end).all():
            break
        end = further
    enters = np.arange(most)
    inside = enters < n
    last = end[np.minimum(enters, max(0, n - 1))] if n else np.zeros(most, np.int64)
    exits = np.where(inside, links[last] - n, enters - n) if n else enters
    lasts = np.where(inside, places[last], -1) if n else np.full(most, -1)
    chunk = t[CHUNK][0].as_py()
    return pa.table({CHUNK: pa.array([chunk], pa.int64()), "exits": pa.array([exits.astype("<i8").tobytes()], pa.binary()), "lasts": pa.array([lasts.astype("<i8").tobytes()], pa.binary())})


def _starts(t, entry, most: int, micros: int):
    """POS, the position of its group's first row, and time of a chunk's rows."""
    import numpy as np
    import pyarrow as pa

    places, times, links = _links(t, most, micros)
    begins = np.zeros(len(places), bool)
    at = entry["enters"][0].as_py()
    while at < len(places):
        begins[at] = True
        at = int(links[at])
    before = entry["last"][0].as_py()
    starts = np.maximum.accumulate(np.where(begins, places, -1 if before is None else before))
    return pa.table({POS: pa.array(places), "_start": pa.array(starts), "_t": pa.array(times)})


class Groups:
    def grouped(self, size: int, value: Column, emit_single_empty: bool = False, name: str = "group") -> OrderedFrame:
        """group_id and an array of size values (the last may have fewer), in turn."""
        at_least("size", size, 1)
        df, group = positions.with_positions(self), free(GROUP, self.by)
        out = df.groupBy(*self.by, F.floor(F.col(POS) / size).alias(group)).agg(in_order(F.col(POS), value).alias(name))
        if emit_single_empty and not self.by:
            none = self.spark.range(1).select(F.lit(0).cast("long").alias(group), F.array().cast(out.schema[name].dataType).alias(name))
            out = out.unionByName(none.where(~self.df.limit(1).select(F.lit(1)).exists()))
        return self.within(out, (group,))

    def sliding(self, size: int, value: Column, name: str = "window") -> OrderedFrame:
        """pos and an array of size values from each place on; all values where there are fewer than size."""
        at_least("size", size, 1)
        found = positions.beside(self, back=size - 1, ahead=1, **{
            name: lambda w: F.collect_list(F.struct(value.alias("v"))).over(w.rowsBetween(1 - size, 0)),
            "_last": lambda w: F.lead(F.lit(True)).over(w).isNull(),
        })
        whole = (F.size(name) == size) | (F.col("_last") & (F.col(POS) < size - 1))
        df = found.where(whole).select(*self.by, F.greatest(F.col(POS) - (size - 1), F.lit(0)).alias(PLACE), F.transform(name, lambda x: x["v"]).alias(name))
        return self.within(df, (PLACE,))

    def grouped_within(self, most: int, micros: int, ts: str, value: str, name: str = "group") -> OrderedFrame:
        """Arrays of values: a group ends with most values, or before the first ts that is micros or more after its own first.

        With keys, a key's rows pass through one task, group by group. Without keys, each row is
        the place from which another would be the next group's first; within a chunk these
        links are followed by pointer doubling for all the places at which a group that began
        before may end, so a chunk says where its last group ends for each of them (a row of
        most numbers), chunk by chunk that gives each one's first group, and each chunk then
        marks its own.
        """
        at_least("most", most, 1)
        if not self.by:
            return self._grouped_by_links(most, micros, ts, value, name)
        kind = self.df.schema[value].dataType.simpleString()

        def step(rows):
            n, held, began = 0, [], 0
            for t, v in rows:
                if held and (len(held) >= most or t - began >= micros):
                    yield n, began, held
                    n, held = n + 1, []
                began = began if held else t
                held.append(v)
            if held:
                yield n, began, held

        group = free(GROUP, self.by)
        timed = self.with_df(self.df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))))
        done = timed._in_order(step, ["_t", value], f"{group} long, started long, `{name}` array<{kind}>")
        return self.within(done, (group,))

    def _grouped_by_links(self, most: int, micros: int, ts: str, value: str, name: str) -> OrderedFrame:
        kind = self.df.schema[value].dataType.simpleString()
        rows = settled(positions.with_positions(self).select(POS, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(value).alias("_v")))
        times = positions.with_halo(rows.select(POS, "_t"), ahead=most)
        exits = times.groupBy(CHUNK).applyInArrow(lambda t: _exits(t, most, micros), f"{CHUNK} long, exits binary, lasts binary")

        def enter(found):
            at, last = 0, None  # the next group's first row, counted from the chunk's; the place of the last one's
            for chunk, ends, lasts in found:
                yield chunk, at, last
                if (own := int.from_bytes(lasts[8 * at : 8 * at + 8], "little", signed=True)) >= 0:
                    last = own
                at = int.from_bytes(ends[8 * at : 8 * at + 8], "little")

        chunks = self.within(exits, (CHUNK,))
        entries = chunks._in_order(enter, [CHUNK, "exits", "lasts"], "entered long, enters long, last long", empty=False)
        starts = times.groupBy(CHUNK).cogroup(entries.groupBy("entered")).applyInArrow(lambda t, e: _starts(t, e, most, micros), f"{POS} long, _start long, _t long")
        grouped = starts.join(rows.select(POS, "_v"), POS).groupBy("_start").agg(F.min(F.when(F.col(POS) == F.col("_start"), F.col("_t"))).alias("started"), in_order(F.col(POS), F.col("_v")).cast(f"array<{kind}>").alias(name))
        numbered = positions.with_positions(self.within(grouped, ("_start",)))
        return self.within(numbered.select(F.col(POS).alias(GROUP), "started", name), (GROUP,))

    def group_by(self, most: int, *keys: str) -> OrderedFrame:
        """A sub-stream for each value of keys. The job fails for a null key, and for more than most values in a stream."""
        at_least("most", most, 1)
        if set(keys) & {*self.by, *self.order}:
            raise ValueError("keys are columns that are neither order nor key")
        null = F.lit(False)
        for k in keys:
            null = null | F.col(k).isNull()
        distinct = self.df.select(*self.by, *keys).distinct()
        n = distinct.groupBy(*self.by).agg(F.count("*").alias("n")).agg(F.max("n")).scalar() if self.by else distinct.limit(most + 1).agg(F.count("*")).scalar()
        fails = F.when(null, F.raise_error(F.lit("a group's key must not be null")).cast("boolean")).when(n > most, F.raise_error(F.lit(f"more than {most} sub-streams")).cast("boolean"))
        return self.cut(self.df.where(F.coalesce(fails, F.lit(True))), *keys)

    def _level(self) -> str:
        """The column of a further level."""
        return free(GROUP, self.df.columns)

    def split(self, command: Column) -> OrderedFrame:
        """Sub-streams by command (one of COMMANDS; null is Emit), numbered from 0."""
        command, level = F.coalesce(command, F.lit(EMIT)), self._level()
        bad = F.when(~command.isin(*COMMANDS), F.raise_error(F.lit("unknown split command")).cast("boolean")).otherwise(F.lit(True))
        marked = self.with_df(self.df.where(bad).withColumn("_cmd", command))
        closes = F.col("_cmd").isin(EMIT_COMPLETE, DROP_COMPLETE).cast("long")
        counted = positions.running(marked, inclusive=False, _closed=("sum", closes)).drop(POS)
        kept = marked.with_df(counted.where(~F.col("_cmd").isin(DROP, DROP_COMPLETE)))
        first = positions.beside(kept, back=1, _before=lambda w: F.lag("_closed").over(w)).drop(POS)
        start = (F.col("_before").isNull() | (F.col("_closed") > F.col("_before")) | (F.col("_cmd") == COMPLETE_EMIT)).cast("long")
        df = positions.running(kept.with_df(first), **{level: ("sum", start)}).withColumn(level, F.col(level) - 1)
        return self.cut(df.drop(POS, "_cmd", "_closed", "_before"), level)

    def split_when(self, where: Column) -> OrderedFrame:
        """A new sub-stream begins with each row for which where is true."""
        start, level = F.coalesce(where & (F.col(POS) > 0), F.lit(False)).cast("long"), self._level()
        return self.cut(positions.running(self, **{level: ("sum", start)}).drop(POS), level)

    def split_after(self, where: Column) -> OrderedFrame:
        """A sub-stream ends with each row for which where is true."""
        ends, level = F.coalesce(where, F.lit(False)).cast("long"), self._level()
        return self.cut(positions.running(self, inclusive=False, **{level: ("sum", ends)}).drop(POS), level)

    def inject_sequential(self, length: int) -> OrderedFrame:
        """Sub-streams of length elements each, as consumers that take so many would get."""
        at_least("length", length, 1)
        return self._dealt(F.floor(F.col(POS) / length))

    def inject_round_robin(self, streams: int) -> OrderedFrame:
        at_least("streams", streams, 1)
        return self._dealt(F.col(POS) % streams)

    def inject_to_any(self, streams: int) -> OrderedFrame:
        """Each element in one of streams sub-streams, by its hash."""
        at_least("streams", streams, 1)
        level = self._level()
        # the level is hashed too: within a sub-stream of such a cut, hashes have one remainder
        return self.cut(self.df.withColumn(level, F.pmod(F.xxhash64(F.lit(level), *self.order), F.lit(streams)).cast("long")), level)

    def inject_broadcast(self, streams: int) -> OrderedFrame:
        """Each element in each of streams sub-streams."""
        at_least("streams", streams, 1)
        level = self._level()
        return self.cut(self.df.withColumn(level, F.explode(F.sequence(F.lit(0), F.lit(streams - 1)).cast("array<long>"))), level).grown()

    def _dealt(self, group: Column) -> OrderedFrame:
        level = self._level()
        return self.cut(positions.with_positions(self).withColumn(level, group.cast("long")).drop(POS), level)

    def prefix_and_tail(self, n: int, value: Column, name: str = "prefix") -> tuple[DataFrame, OrderedFrame]:
        """One row with the array of the first n values (of each key that has rows), and the frame of what follows."""
        at_least("n", n)
        df = positions.with_positions(self)
        head = df.where(F.col(POS) < n)
        if n == 0 and not self.by:
            prefix = self.spark.range(1).select(F.array().cast(f"array<{self.df.select(value.alias('v')).dtypes[0][1]}>").alias(name))
        else:
            prefix = head.groupBy(*self.by).agg(in_order(F.col(POS), value).alias(name))
        return prefix, self.with_df(df.where(F.col(POS) >= n).drop(POS))

    def head_and_tail(self, value: Column, name: str = "head") -> tuple[DataFrame, OrderedFrame]:
        """As prefix_and_tail(1), with the value itself; the job fails for an empty stream."""
        prefix, tail = self.prefix_and_tail(1, value, name)
        head = F.when(F.size(name) == 0, F.raise_error(F.lit("NoSuchElement: the stream is empty"))).otherwise(F.get(name, F.lit(0)))
        return prefix.select(*self.by, head.cast(self.df.select(value.alias("v")).dtypes[0][1]).alias(name)), tail

    def flatten_concat(self) -> OrderedFrame:
        """One stream of each stream of sub-streams: these one after the other."""
        return self.joined(self.df, (*self.innermost, *self.order))

    def flatten_merge(self) -> OrderedFrame:
        """One stream in the elements' own order (any interleaving keeps that of each sub-stream)."""
        return self.joined(self.df, (*self.order, *self.innermost))

    def flatten_round_robin(self) -> OrderedFrame:
        """One stream: the first of each sub-stream, then the second of each, and so on."""
        turn = free("turn", self.df.columns)
        return self.joined(positions.with_positions(self).withColumnRenamed(POS, turn), (turn, *self.innermost))

    def flatten_sorted(self, *values: str) -> OrderedFrame:
        """One stream by values; ties keep the sub-streams' order."""
        own = (*self.innermost, *self.order)
        return self.joined(self.df, (*values, *(c for c in own if c not in values)))

    def flatten_to_seq(self, value: Column, name: str = "row") -> OrderedFrame:
        """Arrays of the sub-streams' elements of the same position; ends with the shortest."""
        df, outer = positions.with_positions(self), self.by[: len(self.by) - len(self.innermost)]
        rows = df.groupBy(*outer, POS).agg(in_order(F.struct(*self.innermost), value).alias(name))
        streams = self.df.select(*self.by).distinct()
        if outer:
            many = streams.groupBy(*(F.col(c).alias(f"_of_{i}") for i, c in enumerate(outer))).agg(F.count("*").alias("_n"))
            same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(outer)])
            rows = rows.join(many, same).where(F.size(name) == F.col("_n")).select(*outer, POS, name)
        else:
            rows = rows.where(F.size(name) == streams.agg(F.count("*")).scalar())
        return self.joined(rows.withColumnRenamed(POS, PLACE), (PLACE,))
