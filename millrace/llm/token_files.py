"""Operator 7, token-id output: ORC files of documents' ids.

Files hold (doc_id, ids) in ascending doc_id order over all files: a range shuffle deals
the texts, each task sorts its range and encodes as it writes, some texts at a time. Ranges
are cut within a doc_id too, so one that many rows have isn't one task's. ORC keeps ids and
doc_ids in integer run-length encoding, in stripes that are read in parallel, with row indexes
and Bloom filters on doc_id by which a search for documents skips stripes and row groups.

What is read back keeps each row's place: file, stripe's part of the file, and row of it.

Defined cases: a null or empty text has the end id alone; rows of one doc_id follow each
other in the order of the table; null doc_ids come first; a text of any length is one row; an empty table writes no rows; other columns aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import pieces
from millrace.llm.shared import shared_path, stash

SCHEMA = "doc_id long, ids array<int>"
STRIPE_BYTES, ROWS_PER_INDEX = 16 << 20, 1000
#: Bytes of texts that are encoded at once (one text may be longer).
AT_ONCE_BYTES = 10 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Encodes docs (doc_id, text) by a byte-level tokenizer and writes them to path in ascending doc_id order."""

    def ids_of(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        encode = pieces.encoder(tokenizer_file)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            first = 0
            while first < len(batch):
                done = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, done + AT_ONCE_BYTES, side="right")))
                doc_ids, texts = (batch.column(i).slice(first, last - first) for i in (0, 1))
                first = last
                numbers, listed = pieces.at_spaces(texts.fill_null(""))
                n_ids, flat = encode.arrays(listed, np.bincount(np.concatenate(numbers), minlength=len(listed)))
                n_ids, flat = np.append(n_ids, 1), np.append(flat, np.int32(end_id))
                stop = np.array([len(listed)])  # each text ends with the piece of the end id
                whole = np.concatenate([x for own in numbers for x in (own, stop)])
                ids, ends = pieces.gathered(whole, np.cumsum(n_ids) - n_ids, n_ids, flat)
                offsets = np.concatenate([[0], ends[np.cumsum([len(own) + 1 for own in numbers]) - 1]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])
                del ids, whole, flat, numbers, listed, texts
                pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ("doc_id", "_row")  # the ranges are found without reading texts
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    (
        ranged.select("doc_id", "text").mapInArrow(ids_of, SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", ROWS_PER_INDEX)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; doc_ids, if given, go to the scan, which prunes by the metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """For each document in the files: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(1)
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.cumsum(np.asarray(ids.value_lengths(), dtype=np.int64))
            starts = np.concatenate([[0], ends[:-1]])
            raw = memoryview(values.tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64()), *batch.columns[2:]], ["doc_id", "n_tokens", "ids_crc32", "_file", "_part", "_row"])

    number = lambda mark: F.regexp_extract("_metadata.file_name", rf"{mark}(\d+)", 1).cast("long")
    file_number = number("part-") * 1_000_000 + number("-c")
    # the rows of a part of a file are read by one task, in their order
    placed = read_tokens(spark, path).select("doc_id", "ids", file_number.alias("_file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_row"))
    counted = stash(placed.mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, _file long, _part long, _row long"), "token-digest")
    earlier_files = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.groupBy("_file").agg(F.sum("n_tokens").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(earlier_files), F.lit(0)).alias("_first"))
    earlier_rows = Window.partitionBy("_file").orderBy("_part", "_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.withColumn("_before", F.coalesce(F.sum("n_tokens").over(earlier_rows), F.lit(0)))
        .join(firsts, "_file")
        .select("doc_id", (F.col("_first") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
    )


def write_and_digest(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write_tokens(docs, path, tokenizer_file, end_id)
    return token_digest(spark, path)
