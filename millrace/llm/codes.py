"""Operator 13, vector code compression: product codes, found by a vantage-point tree of each part position.

A vector of integers is cut into PARTS equal consecutive parts, and a part's code is the index
of the nearest entry in its position's codebook. A codebook begins as the parts of the ENTRIES
smallest vec_ids and is moved ROUNDS times to the means of the parts that are nearest to each.

A task makes a tree of each position's entries (a codebook has ENTRIES at most, so it goes to
every task) and sends its vectors through it, all that reach a node at once, the nearer child
first. A child holds the entries whose distances from a vantage point lie between two radii;
by the triangle inequality it can't hold an entry nearer than the gap between the vector's own
distance and those radii. Radii and distances are rounded outward, and a child is left out
only if the gap is larger than the best distance so far, not if they are the same, so ties are
seen. What decides in a leaf are squared distances in integers.

Spark sums each entry's parts: a task passes on one sum an entry, and the driver gets one row
of each entry.

Defined cases: vectors that are null, or hold null or non-finite components, take no part;
shorter vectors are filled up with 0, to a length that can be cut; with fewer than ENTRIES
vectors a codebook has one entry of each; of rows with equal vec_ids those with the smaller
vector count as smaller, and rows without vec_id come last; rows that repeat are encoded each
for itself; an entry that no part is nearest to stays; components beyond a long count as its
bounds, as do errors; null labels are a label; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash
from millrace.llm.topk import MOST, integers

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf, and vectors that are sent through a tree at once.
LEAF, AT_ONCE = 16, 1 << 13
#: Share by which distances are rounded: above what a square root, a sum and a difference of doubles may be off.
SLACK = 1e-14
#: Labels whose errors (a number each) may go to every task; beyond it they are joined.
BROADCAST_LABELS = 100_000


def squared(a, b):
    """Squared distances of all rows of a from all rows of b, exact: as doubles where they hold all sums, else as Python's integers."""
    import numpy as np

    most = max((float(np.abs(x).max(initial=0)) for x in (a, b)), default=0)
    if 4 * most * most * max(1, a.shape[1]) < 2.0**53:
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    x, y = a.astype(object), b.astype(object)
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)


def _rounded(square):
    """Distances of squared ones, rounded down and up."""
    import numpy as np

    d = np.sqrt(np.asarray(square).astype(float))
    return d * (1 - SLACK), d * (1 + SLACK)


class Tree:
    """A vantage-point tree over entries; visited counts the distances that nearest() looked at."""

    def __init__(self, entries, leaf: int = LEAF):
        import numpy as np

        self.entries, self.leaf, self.visited = entries, leaf, 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, ids):
        """A leaf's entries (ascending), or a vantage point and two children, each with its radii."""
        import numpy as np

        if len(ids) <= self.leaf:
            return np.sort(ids)
        # the vantage point is the entry farthest from the first one: distances from the rim differ most
        vantage = ids[np.argmax(squared(self.entries[ids[:1]], self.entries[ids])[0])]
        square = squared(self.entries[[vantage]], self.entries[ids])[0]
        order = np.argsort(square, kind="stable")
        if square[order[0]] == square[order[-1]]:
            return np.sort(ids)
        children = []
        for own in np.split(order, [len(order) // 2]):
            children.append((_rounded(square[own[0]])[0], _rounded(square[own[-1]])[1], self._node(ids[own])))
        return vantage, children

    def nearest(self, rows):
        """The index and squared distance of each row's nearest entry; of equally near ones the first."""
        import numpy as np

        best, at = np.full(len(rows), MOST, object if rows.dtype == object else np.int64), np.full(len(rows), len(self.entries))
        if len(rows) and len(self.entries):
            sample = squared(rows[:1], self.entries[:1])
            found = best.astype(object) if sample.dtype == object else best
            if found.dtype == object:
                found[:] = [1 << 200] * len(found)
            best = found
            self._visit(self.root, rows, np.arange(len(rows)), best, at)
        return at, best

    def _visit(self, node, rows, who, best, at) -> None:
        import numpy as np

        if isinstance(node, np.ndarray):
            square = squared(rows[who], self.entries[node])
            self.visited += square.size
            place = np.argmin(square, axis=1)
            near, index = square[np.arange(len(who)), place], node[place]
            better = (near < best[who]) | ((near == best[who]) & (index < at[who]))
            best[who[better]], at[who[better]] = near[better], index[better]
            return
        vantage, children = node
        square = squared(rows[who], self.entries[[vantage]])[:, 0]
        self.visited += len(who)
        low, high = _rounded(square)
        gaps = [np.maximum(lo - high, low - hi) for lo, hi, _ in children]
        first = gaps[0] <= gaps[1]
        for nearer, order in ((first, (0, 1)), (~first, (1, 0))):
            for c in order:
                going = np.flatnonzero(nearer)
                going = going[gaps[c][going] <= _rounded(best[who[going]])[1]]
                if len(going):
                    self._visit(children[c][2], rows, who[going], best, at)


class Codebooks:
    """The codebooks of all part positions (position, entry, component) as trees."""

    def __init__(self, entries):
        self.entries = entries
        self.trees = [Tree(e) for e in entries]

    def encode(self, vectors):
        """Indexes and squared distances (vector, position) of vectors (vector, position, component)."""
        import numpy as np

        found = [t.nearest(vectors[:, p]) for p, t in enumerate(self.trees)]
        return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def _vectors(column, parts: int, width: int):
    """(vector, position, component) of an Arrow column of lists, filled up with 0."""
    import numpy as np

    sizes = np.asarray(column.value_lengths(), np.int64)
    data = np.zeros((len(sizes), parts * width), np.int64)
    data[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return data.reshape(len(sizes), parts, width)


def _as_array(entries: list, parts: int, width: int):
    import numpy as np

    return np.array(entries, np.int64).reshape(parts, -1, width)


def _moved(rows: DataFrame, entries: list, parts: int, width: int) -> list:
    """The codebooks after a round over rows (v)."""
    n_entries = len(entries[0])
    shared = rows.sparkSession.sparkContext.broadcast(entries)

    def add(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        books, sums, counts = None, np.zeros((parts * n_entries, width), object), np.zeros(parts * n_entries, np.int64)
        for batch in batches:
            books = books or Codebooks(_as_array(shared.value, parts, width))
            for i in range(0, len(batch), AT_ONCE):
                vectors = _vectors(batch.column(0).slice(i, AT_ONCE), parts, width)
                codes, _ = books.encode(vectors)
                slots = (codes + np.arange(parts) * n_entries).ravel()
                order = np.argsort(slots, kind="stable")
                begins = np.flatnonzero(np.diff(slots[order], prepend=-1))
                flat = vectors.reshape(-1, width)[order]
                exact = float(np.abs(flat).max(initial=0)) * len(flat) < 2.0**62
                sums[slots[order[begins]]] += np.add.reduceat(flat if exact else flat.astype(object), begins, axis=0).astype(object)
                counts += np.bincount(slots, minlength=len(counts))
        if books is not None:
            some = np.flatnonzero(counts)
            kind = pa.list_(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array([[Decimal(int(x)) for x in sums[i]] for i in some.tolist()], kind)], ["slot", "n", "sums"])

    found = rows.select("v").mapInArrow(add, "slot int, n long, sums array<decimal(38,0)>")
    whole = found.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    moved = [[list(e) for e in book] for book in entries]
    for r in whole.collect():  # a row of each entry at most
        moved[r.slot // n_entries][r.slot % n_entries] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return moved


def encode(vectors: DataFrame, parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list]:
    """(vec_id, label, code, error) of each vector that takes part, and the final codebooks (position, entry, component)."""
    if not 1 <= n_entries <= 256:
        raise ValueError("a code of two hex digits has 256 entries at most")
    rows = stash(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), integers(F.col("embedding"), scale).alias("v")).where("v is not null"), "code-vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = [r.v + [0] * (parts * width - len(r.v)) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(n_entries).collect()]
    entries = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), entries
    for _ in range(rounds):
        entries = _moved(rows, entries, parts, width)
    shared = rows.sparkSession.sparkContext.broadcast(entries)

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        books = Codebooks(_as_array(shared.value, parts, width))
        digits = np.array([f"{i:02x}" for i in range(256)], object)
        for batch in batches:
            for i in range(0, len(batch), AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                codes, squares = books.encode(_vectors(part.column("v"), parts, width))
                error = squares.sum(1)
                if error.dtype == object:
                    error = np.array([min(x, MOST) for x in error], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(digits[codes].sum(1), pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id long, label {kind}, code string, error long"), entries


def codes(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector that takes part."""
    found, entries = encode(vectors, **options)
    found = stash(found, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    of_label = stash(found.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "label-errors")
    few = of_label.count() <= BROADCAST_LABELS
    joined = found.join(F.broadcast(of_label) if few else of_label, F.col("label").eqNullSafe(F.col("_label")))
    digest = hashlib.sha256(",".join(str(x) for book in entries for e in book for x in e).encode()).hexdigest()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
