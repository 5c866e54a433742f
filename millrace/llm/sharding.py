"""Operator 8, sharding: extendible hashing with DataFrame functions alone.

A row's key is a 64-bit hash of its doc_id (the leading half of the MD5 of its decimal form,
so that other engines can say it too). The directory is indexed by the hash's leading bits; a
bucket is split on its next bit only while its bytes exceed the limit, so a shard is the
shortest hash prefix whose rows fit.

Bytes are summed for prefixes of so many bits that a prefix has a quarter of the limit on
average; sums of shorter prefixes are sums of those, so one pass over the rows finds nearly
all shards, in a directory of a few rows a shard. What is still too large is summed again on a
few bits more, and again, without the rows that have a shard by then. A prefix that is left
with one hash can't be split further and takes no more passes.

Rows that agree in all 64 bits (copies of one doc_id) can't be split by hash. They fill
overflow pages in turn, each within the limit. A row larger than the limit has a shard of
its own.

Defined cases: a null or empty text counts 0 bytes; a null doc_id is a key like others (the
hash 0); a text of any length is one row; rows that repeat are placed each for itself; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stash

HASH_BITS = 64
#: Bits by which what is too large is split in each further pass.
STEP_BITS = 4


def key(doc_id: Column) -> Column:
    """The hash of a doc_id as a signed long."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("long").cast("string").cast("binary")), 1, 16), 16, -10).cast("long"), F.lit(0).cast("long"))


def _prefix(bits: int) -> Column:
    """The hash's leading bits as a number; all 64 of them are the (signed) hash itself."""
    if bits == 0:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned("_hash", HASH_BITS - bits) if bits < HASH_BITS else F.col("_hash")


def _leaves(sums: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """For each prefix of high bits (_prefix, _bytes): the depth and bytes of its bucket.

    The bucket is the shortest prefix of low bits or more that fits; _depth is null where
    even high bits don't.
    """
    at = F.explode(F.sequence(F.lit(low), F.lit(high)))
    levels = sums.select(at.alias("_at"), "_prefix", "_bytes").select("_at", F.expr(f"shiftright(_prefix, {high} - _at)").alias("_bucket"), "_bytes")
    fits = levels.groupBy("_at", "_bucket").agg(F.sum("_bytes").alias("_sum")).where(F.col("_sum") <= limit)
    fits = stash(fits, "buckets-that-fit")
    # a prefix has buckets of several depths that fit, one below the other: the first is its shard
    above = fits.select((F.col("_at") + 1).alias("_below"), F.col("_bucket").alias("_parent"))
    tops = fits.join(above, (F.col("_at") == F.col("_below")) & (F.expr("shiftright(_bucket, 1)") == F.col("_parent")), "left_anti")
    tops = stash(tops, "shards")
    depths = tops.agg(F.min("_at"), F.max("_at")).first()
    if depths[0] is None:
        return sums.select("_prefix", F.lit(None).cast("int").alias("_depth"), F.lit(None).cast("long").alias("_shard_bytes"))
    at = F.explode(F.sequence(F.lit(depths[0]), F.lit(depths[1])))  # the few depths that there are
    placed = sums.select("_prefix", at.alias("_at")).withColumn("_bucket", F.expr(f"shiftright(_prefix, {high} - _at)")).join(tops, ["_at", "_bucket"])
    return sums.select("_prefix").join(placed.select("_prefix", F.col("_at").alias("_depth"), F.col("_sum").alias("_shard_bytes")), "_prefix", "left")


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows whose hashes agree in all bits.

    Bytes run on in salted groups (by the part of the table a row lies in, which the stash
    has fixed), so a hot key isn't paged by one task. A group's pages are its own; a page
    ends before the row that would exceed the limit, by halves of the limit: rows that
    begin in one half-limit step share a page, and larger rows stand alone.
    """
    half = max(1, limit // 2)
    rows = stash(rows.withColumn("_salt", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "overflow")
    before = Window.partitionBy("_hash", "_salt").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    small = F.col("n_bytes") <= half
    running = F.coalesce(F.sum(F.when(small, F.col("n_bytes")).otherwise(0)).over(before), F.lit(0))
    page = F.when(small, F.concat_ws("-", F.lit("p"), "_salt", F.floor(running / half))).otherwise(F.concat_ws("-", F.lit("r"), "_row"))
    paged = rows.withColumn("_page", page)
    sizes = paged.groupBy("_hash", "_page").agg(F.sum("n_bytes").alias("_page_bytes"))
    return (
        paged.join(sizes.withColumnsRenamed({"_hash": "_h", "_page": "_p"}), (F.col("_hash") == F.col("_h")) & (F.col("_page") == F.col("_p")))
        .select("doc_id", "n_bytes", F.concat(F.lpad(F.lower(F.hex("_hash")), 16, "0"), F.lit("/64/"), "_page").alias("shard"), F.lit(HASH_BITS).alias("depth"), F.col("_page_bytes").alias("shard_bytes"))
    )


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, shard (prefix/depth), depth, shard_bytes for each row of docs."""
    if limit < 1:
        raise ValueError("limit is 1 byte or more")
    rest = stash(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), key(F.col("doc_id")).alias("_hash")), "sizes")
    placed: list[DataFrame] = []
    total = rest.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS - 1, max(1, math.ceil(math.log2(max(1, total / limit))) + 2))
    while True:
        keyed = rest.withColumn("_prefix", _prefix(high))
        sums = stash(keyed.groupBy("_prefix").agg(F.sum("n_bytes").alias("_bytes"), F.min("_hash").alias("_least"), F.max("_hash").alias("_most")), "prefixes")
        if high == HASH_BITS:
            leaves = sums.select("_prefix", F.when(F.col("_bytes") <= limit, F.lit(high)).alias("_depth"), F.col("_bytes").alias("_shard_bytes"))
        else:
            leaves = _leaves(sums.select("_prefix", "_bytes"), limit, low, high)
        leaves = stash(leaves.join(sums.select("_prefix", (F.col("_least") == F.col("_most")).alias("_alone")), "_prefix"), "directory")
        found = keyed.join(leaves, "_prefix")
        name = F.concat_ws("/", F.lpad(F.lower(F.hex(F.expr(f"shiftright(_prefix, {high} - _depth)") if high < HASH_BITS else F.col("_prefix"))), 16, "0"), F.col("_depth").cast("string"))
        placed.append(found.where("_depth is not null").select("doc_id", "n_bytes", name.alias("shard"), F.col("_depth").alias("depth"), F.col("_shard_bytes").alias("shard_bytes")))
        open_, alone = leaves.where("_depth is null").agg(F.count("*"), F.count(F.when(F.col("_alone"), 1))).first()
        if alone:
            placed.append(_paged(found.where("_depth is null and _alone").select("doc_id", "n_bytes", "_hash"), limit))
        if open_ == alone:
            break
        rest = stash(found.where("_depth is null and not _alone").select("doc_id", "n_bytes", "_hash"), "unplaced")
        low, high = high + 1, min(HASH_BITS, high + STEP_BITS)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out
