"""Operator 1, packing: power-of-two decomposition.

Each document's ids (with the end id) are cut into pieces whose lengths are the terms of
their number's binary form, with as many pieces of the maximum length as fit first. A
sequence is one piece: equal lengths share a bucket and are numbered in it, no sequence
crosses documents, and as every length is a power of two no sequence needs padding.

Defined cases: a null or empty text has the end id alone, so one piece of length 1; a text of
any length is one document; pieces of one length lie in the order of hashes of doc_id and
start, ties in any; rows that repeat are packed each for itself; strings of special tokens in a
text are text; a null doc_id is carried; an empty table gives no
rows; other columns of the input aren't read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import pieces
from millrace.llm.shared import stash

#: Rows of one numbering group, and groups that are summed up by one task.
GROUP_ROWS, GROUP_RUN = 50_000, 4096


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as a falling sum of powers of two that are longest at most."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(docs: DataFrame, tokenizer_file: str, end_id: int = 2, longest: int = 4096, drops_space: bool = True, digest: bool = False) -> DataFrame:
    """A row for each piece, with its ids as little-endian unsigned 32-bit integers, or ids_crc32 for digest."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest is a power of two")
    end = int(end_id).to_bytes(4, "little")

    def cut(doc_ids: list, ids: list[bytes]):
        import pyarrow as pa

        rows: list[tuple] = []
        for doc_id, own in zip(doc_ids, ids, strict=True):
            own += end
            start, n = 0, len(own) // 4
            for length in binary_lengths(n, longest):
                rows.append((doc_id, start, length, finish(own[4 * start : 4 * (start + length)]), n))
                start += length
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", name, "doc_tokens"])

    name, finish = ("ids_crc32", zlib.crc32) if digest else ("ids", bytes)
    return pieces.encode(docs, tokenizer_file, drops_space, cut, f"doc_id long, start long, length long, {name} {'long' if digest else 'binary'}, doc_tokens long")


def number_sequences(cut: DataFrame) -> DataFrame:
    """Adds sequence_id, dense over all pieces by falling length, and offset (0).

    Rows of a length are dealt to salted groups, so no length is numbered in one task; sizes
    of lengths, of runs of GROUP_RUN groups, and of groups give each group's first number; a
    task sums the groups of one run, or the runs of one length.
    """
    cut = stash(cut, "pieces")
    salts = max(16, -(-cut.count() // GROUP_ROWS))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sizes = salted.groupBy(F.col("length").alias("_length"), F.col("_salt").alias("_group")).agg(F.count("*").alias("_n"))
    sizes = stash(sizes.withColumn("_run", F.floor(F.col("_group") / GROUP_RUN)), "group-sizes")
    upto = lambda over: F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_runs = sizes.groupBy("_length", "_run").agg(F.sum("_n").alias("_n"))
    of_lengths = of_runs.groupBy("_length").agg(F.sum("_n").alias("_n"))  # a row for each power of two
    of_lengths = of_lengths.select("_length", upto(Window.orderBy(F.col("_length").desc())).alias("_of_length"))
    of_runs = of_runs.select("_length", "_run", upto(Window.partitionBy("_length").orderBy("_run")).alias("_of_run"))
    of_groups = sizes.select("_length", "_run", "_group", upto(Window.partitionBy("_length", "_run").orderBy("_group")).alias("_of_group"))
    firsts = of_groups.join(of_runs, ["_length", "_run"]).join(of_lengths, "_length").select("_length", "_group", (F.col("_of_length") + F.col("_of_run") + F.col("_of_group")).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "start")
    return (
        salted.withColumn("_rank", F.row_number().over(within))
        .join(firsts, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_group")))
        .withColumn("sequence_id", F.col("_first") + F.col("_rank") - 1)
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("_salt", "_rank", "_length", "_group", "_first")
    )


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 2, longest: int = 4096, drops_space: bool = True) -> DataFrame:
    """The packed sequences of docs (doc_id, text) with their ids."""
    return number_sequences(decompose(docs, tokenizer_file, end_id, longest, drops_space))


def packing_digest(docs: DataFrame, tokenizer_file: str, end_id: int = 2, longest: int = 4096) -> DataFrame:
    """pack() with ids_crc32 in place of the ids, which don't move to be numbered."""
    return number_sequences(decompose(docs, tokenizer_file, end_id, longest, digest=True))
