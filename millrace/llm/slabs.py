"""Blocks of vectors in slabs, past which blocks of queries stream.

A block is a bounded number of vectors, packed by the task that holds them. Blocks lie in
slabs, a few blocks each: a task builds what it needs of a slab's blocks once and holds it, and
all blocks of queries stream past it, in turn. Vectors move once and queries once a slab.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a slab at most, and slabs of fewer vectors.
SLAB_VECTORS, SLABS = 1 << 16, 64
#: Slabs that are searched first, where there are more: what they find is a floor for the others.
FIRST_SLABS = 64

#: The bounds of a long; its own least would have no positive.
MOST = 2**63 - 1
#: What stands for a number that is null.
NONE = -(2**63)


def _schema(columns: tuple[str, ...]) -> str:
    return ", ".join(["block long", "n int", "width int", "vectors binary", *(f"`{c}` binary" for c in columns)])


def packed(rows: DataFrame, columns: tuple[str, ...], block_rows: int) -> DataFrame:
    """rows (v, and columns of longs) as blocks of block_rows at most. Vectors take as few bytes a component as hold them."""
    import numpy as np

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n_blocks, part, held, n_held = 0, 0, [], 0
        schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("vectors", pa.binary()), *((c, pa.binary()) for c in columns)])

        def block():
            nonlocal n_blocks
            t = pa.Table.from_batches(held)
            lists = t["v"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.asarray(lists.value_lengths(), np.int64)
            width = max(1, int(sizes.max()))
            data = np.zeros((len(sizes), width), np.int64)
            data[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.maximum(lists.flatten().to_numpy(zero_copy_only=False), -MOST)
            most = int(np.abs(data).max())
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
            n_blocks += 1
            own = {c: t[c].fill_null(NONE).to_numpy().astype("<i8").tobytes() for c in columns}
            return pa.RecordBatch.from_pylist([{"block": (part << 24) + n_blocks, "n": len(sizes), "width": width, "vectors": data.astype(kind).tobytes(), **own}], schema=schema)

        for batch in batches:
            if len(batch):
                part = batch.column(batch.num_columns - 1)[0].as_py()
            while len(batch):
                take = batch.slice(0, block_rows - n_held)
                held.append(take)
                n_held += len(take)
                batch = batch.slice(len(take))
                if n_held == block_rows:
                    yield block()
                    held, n_held = [], 0
        if n_held:
            yield block()

    return rows.select("v", *columns, F.spark_partition_id().cast("long").alias("_part")).mapInArrow(pack, _schema(columns))


def _arrays(row: dict, columns: tuple[str, ...]) -> dict:
    import numpy as np

    vectors = np.frombuffer(row["vectors"], f"<i{len(row['vectors']) // (row['n'] * row['width'])}").reshape(row["n"], row["width"]).astype(np.int64)
    return {"v": vectors, **{c: np.frombuffer(row[c], "<i8") for c in columns}}


def number_of_slabs(n_rows: int, block_rows: int) -> int:
    return -(-n_rows // min(SLAB_VECTORS, max(block_rows, n_rows // SLABS))) or 1


def past(blocks: DataFrame, of: tuple[str, ...], asked: DataFrame, asks: tuple[str, ...], slabs: int, among: range, build: Callable[[dict], Any], search: Callable[[list, dict], list], schema: str) -> DataFrame:
    """What search(built blocks, a block of queries) finds in each slab of among, as arrays of schema's columns (longs)."""
    both = tuple(dict.fromkeys((*of, *asks)))
    some = lambda have: [F.col(c) if c in have else F.lit(None).cast("binary").alias(c) for c in both]
    slab = F.pmod(F.xxhash64("block"), F.lit(slabs)).cast("int")
    held = blocks.select(slab.alias("slab"), F.lit(0).alias("asks"), "block", "n", "width", "vectors", *some(of)).where(F.col("slab").between(among.start, among.stop - 1))
    asking = asked.select(F.explode(F.sequence(F.lit(among.start), F.lit(among.stop - 1))).alias("slab"), F.lit(1).alias("asks"), "block", "n", "width", "vectors", *some(asks))
    # a slab's vectors come before the queries
    met = held.unionByName(asking).repartition(len(among), "slab").sortWithinPartitions("slab", "asks", "block")
    names = [x.split()[0] for x in schema.split(", ")]

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        built: list = []
        at = None
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["slab"] != at:
                    at, built = r["slab"], []
                if not r["asks"]:
                    built.append(build(_arrays(r, of)))
                elif built and (found := search(built, _arrays(r, asks))):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    return met.mapInArrow(look, schema)


def best_of(find: Callable[[DataFrame | None, range], DataFrame], asker: list[str], k: int, slabs: int, ties: Column) -> DataFrame:
    """The k rows of the highest score (then the least ties) of each asker, ranked, of what find(floors, slabs) gives in all slabs.

    Where there are more than FIRST_SLABS slabs, what is found in the first is a floor: a row of
    asker and floor (a score that k rows reach), so the others give only what may be among the best.
    """
    order = Window.partitionBy(*asker).orderBy(F.col("score").desc(), ties)
    rank = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if slabs <= FIRST_SLABS:
        return rank(find(None, range(slabs)))
    from millrace.llm.shared import stash

    first = stash(rank(find(None, range(FIRST_SLABS))), "first-slabs")
    floors = first.where(F.col("rank") == k).select(*asker, F.col("score").alias("floor"))
    return rank(first.drop("rank").unionByName(find(floors, range(FIRST_SLABS, slabs))))
