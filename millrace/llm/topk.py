"""Operator 5, exact top-k search: an impact-ordered index, read score at a time.

Vectors of integers lie in blocks of bounded size. A block's index has posting segments: a
segment holds the vectors whose component of one dimension has one quantised value (its
impact), with no more said of them. Segments are read by descending size of the impact, for
a block of queries at once, and add query component times impact to each vector's estimate.

A vector's unread components are below the impacts read so far, and read ones lie within
half a quantum of their impact, so every score is within a known bound of its estimate.
Reading stops only where that proves that all but a few vectors are below the k-th best,
or at the last segment. What may still be a member is scored anew from the whole vectors,
so results are exact, ties included.

Queries are rows of the same table, in blocks, which stream past slabs of indexed blocks of
vectors (slabs.py). Where there are many slabs, the k-th best score of the first ones is a
query's floor in the others, which give only what reaches it. A query for which reading has
stopped leaves its block, so one that needs more segments doesn't keep the others.

Defined cases: vectors that are null, or hold null or non-finite components, take no part;
missing components of shorter vectors count 0, as do all of an empty one; rows that repeat
take part each for itself; a row without vec_id is a candidate but no query; with fewer
candidates than k all are returned; components beyond a long count as its bounds, as do
scores; ties of scores go to the smaller vec_id; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash
from millrace.llm.slabs import MOST, NONE, best_of, number_of_slabs, packed, past

K = 10
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 512
#: Quanta of the largest component, above 0.
LEVELS = 12
#: Possible members a query at which reading may stop.
FEW = 64

OF, ASKS = ("vec_id", "row_id"), ("vec_id", "row_id", "floor")


def integers(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, null for a vector that takes no part."""
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & ok, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Index:
    """A block's posting segments by descending impact."""

    def __init__(self, data, levels: int = LEVELS):
        import numpy as np

        self.data = data
        self.quantum = max(1.0, float(np.abs(data).max(initial=0)) / levels)
        self.impacts = np.rint(data / self.quantum).astype(np.int64)  # within half a quantum of each component
        self.segments = []
        for d in range(data.shape[1]):
            column = self.impacts[:, d]
            order = np.argsort(column, kind="stable")
            cuts = np.flatnonzero(np.diff(column[order])) + 1
            for part in np.split(order, cuts):
                if len(part) and column[part[0]]:
                    self.segments.append((abs(int(column[part[0]])), int(column[part[0]]), d, part))
        self.segments.sort(key=lambda s: (-s[0], s[2], s[1]))


def exactly(queries, data):
    """Inner products, exact: by doubles where they hold all the sums, else by integers; within the bounds of a long."""
    import numpy as np

    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[-1]
    if most < 2.0**53:
        return (queries.astype(float) @ data.astype(float).T).astype(np.int64)
    if most < 2.0**62:
        return queries @ data.T
    return np.clip(queries.astype(object) @ data.astype(object).T, -MOST, MOST).astype(np.int64)


def search(queries, query_rows, index: Index, ids, rows, k: int, few: int = FEW, floors=None) -> Iterator:
    """(query's number, vec_ids, scores): its k best of the block or more, other than its own row; none below its floor."""
    import numpy as np

    n = len(index.data)
    q = queries.astype(float)
    whole = np.abs(q).sum(1)
    floors = np.full(len(queries), -MOST) if floors is None else floors
    live = np.arange(len(queries))
    estimate, column = np.zeros((n, len(queries))), np.ascontiguousarray(q.T) * index.quantum
    at, last = 0, len(index.segments)
    while len(live):
        level = index.segments[at][0] if at < last else 0
        while at < last and index.segments[at][0] == level:
            _, impact, d, part = index.segments[at]
            estimate[part] += column[d] * impact
            at += 1
        # unread components are within level - 1/2 quanta of 0, read ones within half a quantum
        unread = max(0.5, level - 0.5) if at < last else 0.5
        bound = whole[live] * index.quantum * unread * (1 + 1e-9) + 1e-6
        own = floors[live].astype(float)
        least = np.where(floors[live] > -MOST, own - np.abs(own) * 1e-15, -np.inf)
        if n > k + 1:
            # the query's own row may be among the k + 1 best
            least = np.maximum(least, np.partition(estimate, n - k - 1, axis=0)[n - k - 1] - bound)
        possible = estimate + bound >= least
        ends = possible.sum(0) <= max(few, 2 * k) if at < last else np.ones(len(live), bool)
        for i in np.flatnonzero(ends).tolist():
            who = int(live[i])
            found = np.flatnonzero(possible[:, i] & (rows != query_rows[who]))
            if len(found):
                scores = exactly(queries[who : who + 1], index.data[found])[0]
                found, scores = found[scores >= floors[who]], scores[scores >= floors[who]]
                best = np.lexsort((ids[found], -scores))[:k]
                if len(best):
                    yield who, ids[found[best]], scores[best]
        if ends.any():  # those that are done leave
            live, estimate, column = live[~ends], estimate[:, ~ends], column[:, ~ends]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = 1024, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with other rows of vectors."""
    import numpy as np

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"), is_query.alias("asks")).where("v is not null")
    rows = stash(rows.withColumn("row_id", F.monotonically_increasing_id()), "vectors")
    blocks = packed(rows, OF, block_vectors)
    queries = rows.where("asks and vec_id is not null").select("vec_id", "row_id", "v")
    # queries are few: their blocks fill up in fewer, larger parts
    parts = max(1, queries.count() // (4 * block_queries))
    slabs = number_of_slabs(rows.count(), block_vectors)

    def find(floors, among):
        asked = queries.withColumn("floor", F.lit(-MOST)) if floors is None else queries.join(floors, "row_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-MOST)))
        asked = stash(packed(asked.repartition(parts), ASKS, block_queries), "queries")
        return past(blocks, OF, asked, ASKS, slabs, among, lambda b: (Index(b["v"]), b["vec_id"], b["row_id"]), look, "query_id long, row_id long, vec_id long, score long")

    def look(indexes: list, q: dict):
        found = []
        for index, vec_ids, vec_rows in indexes:
            width = index.data.shape[1]  # what a block lacks counts 0
            vectors = np.pad(q["v"][:, :width], ((0, 0), (0, max(0, width - q["v"].shape[1]))))
            found += [(np.full(len(v), i), v, s) for i, v, s in search(vectors, q["row_id"], index, vec_ids, vec_rows, k, floors=q["floor"])]
        if not found:
            return None
        asker, vecs, scores = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((vecs, -scores, asker))
        asker, vecs, scores = asker[order], vecs[order], scores[order]
        best = np.arange(len(asker)) - np.searchsorted(asker, asker) < k
        return [c[best].astype(np.int64) for c in (q["vec_id"][asker], q["row_id"][asker], vecs, scores)]

    found = best_of(find, ["row_id"], k, slabs, F.col("vec_id"))
    return found.select("query_id", "rank", F.when(F.col("vec_id") != NONE, F.col("vec_id")).alias("vec_id"), "score")
