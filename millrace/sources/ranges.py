"""Files as ranges of bytes: a data source whose partitions are ranges, and one whose tasks write theirs.

A task reads its own range, a piece at a time, so a file of any size is read by as many tasks
as it has ranges; of more than MOST_SMALL ranges smaller than RANGE_BYTES a task reads several. What a range's edges cut is carried: a line belongs to the range in which it
begins, and its task reads on past the range's end until the line ends; so do the bytes of a
character. The order is the path and the place of a piece's first byte.

Files are opened with Arrow's file systems: local ones (that all executors share), HDFS and
object stores.
"""

from __future__ import annotations

import os
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a range, unless a caller says otherwise.
RANGE_BYTES = 64 << 20
#: Ranges that are tasks of their own, however small they are; beyond it neighbours share a task.
MOST_SMALL = 64
KINDS = ("bytes", "lines", "text")


def resolve(path: str) -> str:
    """path with a leading ~ put out."""
    return os.path.expanduser(path)


def files_of(path: str) -> list[tuple[str, int]]:
    """The files at path (a file, or a folder's own files but for hidden ones), with their sizes."""
    from pyarrow import fs

    system, at = open_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    inside = system.get_file_info(fs.FileSelector(at))
    return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in inside if x.type == fs.FileType.File and x.base_name[0] not in "._")


def open_system(path: str) -> tuple[Any, str]:
    """Arrow's file system for path, and path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def pieces(f: Any, start: int, end: int, kind: str, piece_bytes: int):
    """(place, value) of what begins in [start, end) of the open file f: chunks of piece_bytes, lines (without \\n), or chunks of whole characters."""
    if kind == "bytes":
        f.seek(start)
        while start < end and (data := f.read(min(piece_bytes, end - start))):
            yield start, data
            start += len(data)
    elif kind == "text":
        f.seek(start)
        at, held = start, f.read(min(piece_bytes, end - start) + 3)
        while held:
            own = min(piece_bytes, end - at)
            first = 0
            if at == start and start:  # a character's further bytes are the range's before
                while first < min(3, len(held)) and held[first] & 0xC0 == 0x80:
                    first += 1
            last = min(own, len(held))
            while last < len(held) and last < own + 3 and held[last] & 0xC0 == 0x80:
                last += 1
            if first < own and first < last:
                yield at + first, held[first:last]
            at += max(own, last)
            if at >= end:
                return
            f.seek(at)
            held = f.read(min(piece_bytes, end - at) + 3)
    else:
        at = start
        if start:  # the line that goes on here is the range's before: skip to the end of what the byte before begins or ends
            f.seek(start - 1)
            at = start - 1
            while (data := f.read(piece_bytes)) and b"\n" not in data:
                at += len(data)
            if not data:
                return
            at += data.index(b"\n") + 1
            f.seek(at)
        held: list[bytes] = []  # of a line that isn't read to its end
        while at < end:
            data = f.read(piece_bytes)
            if not data:
                if held:
                    yield at, b"".join(held)
                return
            first, *more = data.split(b"\n")
            held.append(first)
            for line in more:
                whole = b"".join(held)
                yield at, whole
                at += len(whole) + 1
                held = [line] if line else []
                if at >= end:
                    return


def together(ranges: list[tuple[str, int, int]], kind: str) -> list[list[tuple[str, int, int]]]:
    """ranges (path, start, end), in order, as runs for a task each.

    Where a range ends makes no difference to lines, nor to chunks of bytes, so neighbours are
    one range there; a text's chunks end with each.
    """
    n = min(len(ranges), max(MOST_SMALL, -(-sum(end - start for _, start, end in ranges) // RANGE_BYTES)))
    runs = []
    for i in range(n):
        run: list[tuple[str, int, int]] = []
        for path, start, end in ranges[i * len(ranges) // n : (i + 1) * len(ranges) // n]:
            if kind != "text" and run and run[-1][0] == path and run[-1][2] == start:
                run[-1] = (path, run[-1][1], end)
            else:
                run.append((path, start, end))
        runs.append(run)
    return runs


def _source() -> type:
    """The data source's class: made here, so it travels to executors whole."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Ranges(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            from millrace.sources.ranges import files_of, together

            n = int(self.options["range_bytes"])
            found = [(p, at, min(size, at + n)) for p, size in files_of(self.options["path"]) for at in range(0, size, n)]
            return [InputPartition(x) for x in together(found, self.options["kind"])] or [InputPartition([])]

        def read(self, partition):
            import io

            import pyarrow as pa

            from millrace.sources.ranges import open_system, pieces

            names, held, size = ["path", "place", "value"], [], 0

            def batch():
                return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held]), pa.array([x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.binary())], names)

            kind, piece_bytes, opened, f = self.options["kind"], int(self.options["piece_bytes"]), None, None
            try:
                for path, start, end in partition.value:
                    if path != opened:
                        if f is not None:
                            f.close()
                        system, at = open_system(path)
                        # small pieces come from a buffer
                        opened, f = path, io.BufferedReader(system.open_input_file(at), 1 << 16)
                    for place, value in pieces(f, start, end, kind, piece_bytes):
                        held.append((path, place, value))
                        size += len(value)
                        if size > 4 << 20 or len(held) >= 10_000:
                            yield batch()
                            held, size = [], 0
            finally:
                if f is not None:
                    f.close()
            if held:
                yield batch()

    class FileRanges(DataSource):
        @classmethod
        def name(cls) -> str:
            return "file_ranges"

        def schema(self) -> str:
            return "path string, place long, value binary"

        def reader(self, schema):
            return Ranges(dict(self.options))

    return FileRanges


def read_ranges(spark: SparkSession, path: str, kind: str, piece_bytes: int = 1 << 16, range_bytes: int | None = None) -> DataFrame:
    """path, place and value (bytes) of the pieces of a file or a folder's files."""
    if kind not in KINDS:
        raise ValueError(f"one of {KINDS}")
    if piece_bytes < 1 or (range_bytes is not None and range_bytes < 1):
        raise ValueError("sizes are 1 or more")
    whole = resolve(path)
    n = range_bytes or RANGE_BYTES
    n = -(-n // piece_bytes) * piece_bytes if kind == "bytes" else n  # chunks lie as in one reading
    spark.dataSource.register(_source())
    return spark.read.format("file_ranges").options(path=whole, kind=kind, piece_bytes=piece_bytes, range_bytes=n).load()


def _sink() -> type:
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    @dataclass
    class Written(WriterCommitMessage):
        n_bytes: int

    class Places(DataSourceArrowWriter):
        """Writes each row's bytes at its place of one file, which takes its name when all have."""

        def __init__(self, path: str, made: str, base: int):
            self.path, self.made, self.base = path, made, base

        def write(self, iterator):
            n, first, held, size = 0, 0, [], 0  # values that lie side by side are written as one
            with open(self.made, "r+b") as f:

                def put():
                    f.seek(self.base + first)
                    return f.write(b"".join(held))

                for batch in iterator:
                    for place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        if data:
                            if held and (place != first + size or size >= 1 << 20):
                                n += put()
                                held, size = [], 0
                            if not held:
                                first = place
                            held.append(data)
                            size += len(data)
                if held:
                    n += put()
                f.flush()
                os.fsync(f.fileno())
            return Written(n)

        def commit(self, messages):
            n = sum(m.n_bytes for m in messages if m)
            if os.path.getsize(self.made) != self.base + n:
                self.abort(messages)
                raise OSError("the parts don't fill the file")
            if self.made != self.path:
                os.replace(self.made, self.path)

        def abort(self, messages):
            if self.made != self.path:
                if os.path.exists(self.made):
                    os.remove(self.made)
            else:
                os.truncate(self.path, self.base)

    class OneFile(DataSource):
        @classmethod
        def name(cls) -> str:
            return "one_file"

        def writer(self, schema, overwrite):
            return Places(self.options["path"], self.options["made"], int(self.options["base"]))

    return OneFile


def write_places(df: DataFrame, path: str, append: bool = False) -> int:
    """Writes df (place, value) to one file, as many tasks as df has partitions, each row at its place; the number of bytes.

    A new file is written beside path and named at the end; if a task fails, it goes. Of a file
    that is appended to what was there stays. A task that is run again writes the same bytes to
    the same places. The folder is one that all executors share.
    """
    whole = resolve(path)
    base = os.path.getsize(whole) if append and os.path.exists(whole) else 0
    made = whole if append else f"{whole}.{uuid.uuid4().hex}"
    with open(made, "ab" if append else "wb"):
        pass
    df.sparkSession.dataSource.register(_sink())
    try:
        df.write.format("one_file").mode("append").options(path=whole, made=made, base=base).save()
    except Exception:
        # Spark doesn't call abort() where the job ends before its tasks do
        if made != whole and os.path.exists(made):
            os.remove(made)
        elif made == whole:
            os.truncate(whole, base)
        raise
    return os.path.getsize(whole) - base
