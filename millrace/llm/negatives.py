"""Operator 12, hard-negative mining: a vantage-point tree over norm-augmented vectors.

A vector x of a block gets one more component, the root of M - |x|^2, where M is the block's
largest squared norm, and an anchor a the component 0. Then the squared distance of the two is
|a|^2 + M - 2 a.x: the higher the score, the nearer, and scores between two limits are the
distances of an annulus.

A block's vantage-point tree halves its vectors, again and again, by their distance from a
vantage point. For an anchor, each leaf's distances lie within two radii, by the triangle
inequality; they are rounded outward. Leaves are visited nearest first, from the annulus' inner
rim outward, until k rows of the wanted kind are found and no leaf that is left can hold one as
near (one that may be just as near is still visited). What decides are integer scores. An
anchor's leaves are looked at one after the other, those of many anchors at once.

Blocks lie in slabs, past which blocks of anchors stream (slabs.py): first for the positives,
the best rows of the anchor's label; then, for each anchor and positive, for the best rows of
other labels in the positive's annulus. Labels aren't what rows are dealt by, so a label with a
third of all rows is in all slabs alike.

Defined cases: rows with a null label, a null vector, or null or non-finite components take no
part; missing components of shorter vectors count 0; rows that repeat take part each for itself
(the anchor's own row alone is left out); a row without vec_id is no anchor, and comes before
all others among ties; ties of scores go to the smaller vec_id; an anchor without positives, and
a positive whose annulus is empty (as where its score is negative), give no rows; components and
scores beyond a long count as its bounds; an empty table gives no rows; other columns aren't
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash
from millrace.llm.slabs import MOST, NONE, best_of, number_of_slabs, packed, past
from millrace.llm.topk import exactly, integers

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
LEAF = 128
#: Share of the largest squared distance by which squares are rounded, above what sums of doubles may be off.
SLACK = 1e-12

OF, ASKS = ("vec_id", "row_id", "label"), ("row_id", "label", "place", "low", "high", "floor")
FOUND = "row_id long, place long, vec_id long, score long"


class Tree:
    """A vantage-point tree over augmented vectors (rows of integers)."""

    def __init__(self, data, leaf: int = LEAF):
        import numpy as np

        self.data = data.astype(float)
        self.norms = (self.data * self.data).sum(1)
        self.most = self.norms.max()
        self.extra = np.sqrt(self.most - self.norms)
        self.leaf = leaf
        self.vantages: list[int] = []
        #: Of each leaf: its rows, and (number of the vantage point, least and largest distance) on the way to it.
        self.leaves: list[tuple] = []
        self._divide(np.arange(len(data)), [])

    def _divide(self, rows, path: list) -> None:
        import numpy as np

        if len(rows) <= self.leaf:
            self.leaves.append((np.sort(rows), path))
            return
        square = self._squares(rows[0], rows)
        vantage = rows[np.argmax(square)]  # the farthest from some row: distances from the rim differ most
        square = self._squares(vantage, rows)
        order = np.argsort(square, kind="stable")
        self.vantages.append(int(vantage))
        at, off = len(self.vantages) - 1, SLACK * 4 * self.most
        for own in np.split(order, [len(order) // 2]):
            low, high = np.sqrt(max(0.0, square[own[0]] - off)), np.sqrt(square[own[-1]] + off)
            self._divide(rows[own], [*path, (at, low, high)])

    def _squares(self, i, rows):
        """Squared distances of augmented row i from others."""
        import numpy as np

        return np.maximum(0, self.norms[i] + self.norms[rows] - 2 * (self.data[rows] @ self.data[i]) + (self.extra[rows] - self.extra[i]) ** 2)

    def bounds(self, queries):
        """The least and highest score that each leaf's rows may have, for each query (leaf, query)."""
        import numpy as np

        own = (queries * queries).sum(1)
        square = own[:, None] + self.most - 2 * (queries @ self.data[self.vantages].T)
        off = SLACK * 4 * (self.most + own)[:, None]
        near, far = np.sqrt(np.maximum(0, square - off)), np.sqrt(np.maximum(0, square) + off)
        least, highest = np.empty((len(self.leaves), len(queries))), np.empty((len(self.leaves), len(queries)))
        for i, (_, path) in enumerate(self.leaves):
            inner, outer = np.zeros(len(queries)), np.full(len(queries), np.inf)
            for at, low, high in path:
                inner = np.maximum(inner, np.maximum(low - far[:, at], near[:, at] - high))
                outer = np.minimum(outer, far[:, at] + high)
            highest[i] = (own + self.most + off[:, 0] - inner**2) / 2
            least[i] = (own + self.most - off[:, 0] - outer**2) / 2
        return least, highest


class Block:
    """A block's rows in the order of vec_id, and their tree."""

    def __init__(self, arrays: dict, leaf: int = LEAF):
        import numpy as np

        order = np.argsort(arrays["vec_id"], kind="stable")
        self.data, self.ids, self.rows, self.labels = (arrays[c][order] for c in ("v", "vec_id", "row_id", "label"))
        self.tree = Tree(self.data, leaf)

    def search(self, q: dict, k: int, same: bool):
        """(query, vec_id, score): each query's k highest scores between low and high and from floor on, of rows with its label (same) or another."""
        import numpy as np

        width = self.data.shape[1]  # what a block lacks counts 0
        vectors, asker = np.unique(np.pad(q["v"][:, :width], ((0, 0), (0, max(0, width - q["v"].shape[1])))), axis=0, return_inverse=True)
        asker = asker.ravel()
        n, data, leaves = len(asker), self.data, self.tree.leaves
        low = np.maximum(q["low"], q["floor"])
        fits = float(np.abs(vectors).max(initial=0)) * float(np.abs(data).max(initial=0)) * width < 2.0**52
        if fits:
            least, highest = (x[:, asker] for x in self.tree.bounds(vectors.astype(float)))
        else:  # beyond what doubles hold every leaf is visited
            least, highest = np.full((len(leaves), n), -np.inf), np.full((len(leaves), n), np.inf)
        reach = np.minimum(highest, q["high"])
        order = np.argsort(-reach, axis=0, kind="stable")
        best = np.full((n, k), NONE)
        kth = low.copy()  # what is below can't be among the k best
        found: list = []
        going = np.arange(n)
        for step in range(len(leaves)):
            at = order[step, going]
            # those that are left reach no more than this one
            going, at = (x[reach[at, going] >= kth[going]] for x in (going, at))
            if not len(going):
                break
            inside = least[at, going] <= q["high"][going]
            for leaf in np.unique(at[inside]).tolist():
                own, who = leaves[leaf][0], going[inside & (at == leaf)]
                some, back = np.unique(asker[who], return_inverse=True)
                score = exactly(vectors[some], data[own])[back]
                good = (score >= kth[who][:, None]) & (score <= q["high"][who][:, None]) & ((self.labels[own] == q["label"][who][:, None]) == same) & (self.rows[own] != q["row_id"][who][:, None])
                i, j = np.nonzero(good)
                if not len(i):
                    continue
                some = np.unique(i)
                both = np.concatenate([best[who[some]], np.where(good[some], score[some], NONE)], axis=1)
                best[who[some]] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kth[who[some]] = np.maximum(kth[who[some]], best[who[some]].min(1))
                found.append((who[i], self.ids[own[j]], score[i, j]))
        if not found:
            return None
        who, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return _best(who, ids, score, k)


def _best(who, ids, score, k: int):
    """The k rows of the highest scores, then the smallest ids, of each who."""
    import numpy as np

    order = np.lexsort((ids, -score, who))
    who, ids, score = who[order], ids[order], score[order]
    picked = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[picked], ids[picked], score[picked]


def limits(score, low: int, high: int):
    """The least and highest whole numbers n with low * score <= 100 * n <= high * score."""
    import numpy as np

    s = score.astype(object) if float(np.abs(score.astype(float)).max(initial=0)) * max(low, high) >= 2.0**62 else score
    return (-((-low * s) // 100)).astype(np.int64), (high * s // 100).astype(np.int64)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over vectors (vec_id, embedding, label)."""
    import numpy as np

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"), (F.col("label") if label is None else label).cast("long").alias("label"), is_anchor.alias("asks"))
    rows = stash(rows.where("v is not null and label is not null").withColumn("row_id", F.monotonically_increasing_id()), "mining-rows")
    blocks = stash(packed(rows, OF, block_vectors), "mining-blocks")
    slabs = number_of_slabs(rows.count(), block_vectors)
    anchors = rows.where("asks and vec_id is not null")

    def search(queries: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """The k best of each query (row_id, v, label, place, score: that of its positive, null where none is needed)."""

        def find(floors, among):
            asked = queries.withColumn("floor", F.lit(-MOST)) if floors is None else queries.join(floors, ["row_id", "place"], "left").withColumn("floor", F.coalesce("floor", F.lit(-MOST)))
            parts = max(1, asked.count() // (2 * block_queries))
            asked = stash(packed(asked.repartition(parts), ("row_id", "label", "place", "score", "floor"), block_queries), name)

            def look(built, q):
                none = q["score"] == NONE
                least, most = limits(np.where(none, 0, q["score"]), low, high)
                q["low"], q["high"] = np.where(none, -MOST, least), np.where(none, MOST, most)
                found = [x for b in built if (x := b.search(q, k, same)) is not None]
                if not found:
                    return None
                who, ids, score = _best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
                return q["row_id"][who], q["place"][who], ids, score

            return past(blocks, OF, asked, ("row_id", "label", "place", "score", "floor"), slabs, among, lambda a: Block(a, leaf), look, FOUND)

        return best_of(find, ["row_id", "place"], k, slabs, F.col("vec_id"))

    alone = anchors.select("row_id", "v", "label", F.lit(0).cast("long").alias("place"), F.lit(None).cast("long").alias("score"))
    near = stash(search(alone, positives, True, "anchors").select("row_id", F.col("rank").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # a score below 0 has no number between its hundredths
    pairs = stash(near.where("positive_score >= 0").join(anchors.select("row_id", F.col("vec_id").alias("anchor_id"), "v", "label"), "row_id"), "pairs")
    asked = pairs.select("row_id", "v", "label", "place", F.col("positive_score").alias("score"))
    far = search(asked, negatives, False, "pairs-asked").select("row_id", "place", "rank", "vec_id", F.col("score").alias("negative_score"))
    named = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return far.join(pairs.drop("v", "label"), ["row_id", "place"]).select("anchor_id", named("positive_id").alias("positive_id"), "rank", named("vec_id").alias("negative_id"), "positive_score", "negative_score")
