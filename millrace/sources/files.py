"""Files as streams of bytes, lines or rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.frame import OrderedFrame
from millrace.functions.text import decode
from millrace.sources.ranges import read_ranges, resolve

CHUNK_BYTES = 8192


def from_file(spark: SparkSession, path: str, chunk_bytes: int = 0, range_bytes: int | None = None) -> OrderedFrame:
    """Each file's bytes in chunks, in order of path and pos; the last may be shorter, and an empty file has none."""
    n = chunk_bytes or CHUNK_BYTES
    df = read_ranges(spark, path, "bytes", n, range_bytes)
    return OrderedFrame.of(df.select("path", F.expr(f"place div {n}").alias("pos"), "value"), ("path", "pos"))


def from_file_lines(spark: SparkSession, path: str, range_bytes: int | None = None, charset: str = "UTF-8", on_malformed: str = "replace") -> OrderedFrame:
    """Each file's lines, in order of path and place (of the line's first byte), cut as functions.text.lines does.

    A line is read whole by the task in whose range it begins. charset has \n as a byte of its own.
    """
    df = read_ranges(spark, path, "lines", range_bytes=range_bytes)
    return OrderedFrame.of(df.select("path", "place", decode(F.col("value"), charset, on_malformed).alias("value")), ("path", "place"))


def from_file_text(spark: SparkSession, path: str, chunk_bytes: int = 0, range_bytes: int | None = None, on_malformed: str = "report") -> OrderedFrame:
    """Each file's UTF-8 text in chunks of whole characters, in order of path and place (of the chunk's first byte)."""
    df = read_ranges(spark, path, "text", chunk_bytes or CHUNK_BYTES, range_bytes)
    return OrderedFrame.of(df.select("path", "place", decode(F.col("value"), "UTF-8", on_malformed).alias("value")), ("path", "place"))


def read_file(path: str) -> bytes:
    with open(resolve(path), "rb") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str, order: str | tuple[str, ...], by: str | tuple[str, ...] = ()) -> OrderedFrame:
    """A Parquet table in an order."""
    from millrace import session

    return OrderedFrame.of(session.table(spark, sf_dir, name), order, by)
