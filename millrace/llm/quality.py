"""Operator 6, quality classifier: Bradley-Terry ranking of preference pairs.

A document's score is linear in features of its whole text: measures of its form, and the
shares of its words and of its runs of four bytes that fall in each of HASHED places by their
hashes, so that what it says counts too. Preference pairs put a document of label 1 over one
of label 0; the weights minimise the logistic loss of the features'
differences. The threshold is the quantile of scores at the labelled share of label 0, and
the reported score is the logistic function of the distance from it.

Learning takes all labelled rows. They are dealt by hash to blocks of some BLOCK_ROWS; in each, a
row of the label that has more is paired with PARTNERS rows of the other, dealt so that all of
those are in pairs too. Where a label is so rare that blocks would have few of it, its rows go to
several blocks. Blocks are written once; each Newton step sums the blocks' gradients and
curvatures, made in the tasks that read them. The threshold is found among all scores by their order.

Defined cases: null and empty texts have the features of no words and are scored like
others; a text of any length is measured whole; a score at the threshold counts as label 1; labels that are null or not 0 or 1 are left out; a document with several labels
counts as its lowest; with labels of one kind, or none, all get that label (1 if none); rows
that repeat are scored each for itself; an empty table gives no rows; other columns are carried
if they are named, else not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = 60_000
RIDGE = 1e-3
#: Labelled rows of a block, rows of the rarer label that it should have, and rows with which each of the other is paired.
BLOCK_ROWS, RARE_ROWS, PARTNERS = 4096, 256, 4
#: Labels (some 20 bytes each) that may go to every task; beyond it they are joined with the features.
BROADCAST_LABELS = 2_000_000

#: Places of words, and of runs of bytes.
HASHED = 64
#: What their shares weigh beside the measures, before training: they are many, and labels few.
HASHED_WEIGHT = 0.2
#: Pairs whose differences are laid out at once.
PAIRS_AT_ONCE = 10_000

MEASURES = (
    "log_words", "square_of_log", "shortness", "word_chars", "long_words", "upper", "root_of_upper", "symbols", "root_of_symbols", "exclaim", "digits", "bars", "other",
    "stops", "commas", "lines", "repeated", "root_of_repeated", "same_lines", "distinct", "top_word", "bytes_used",
)
FEATURES = (*MEASURES, *(f"words_{i}" for i in range(HASHED)), *(f"bytes_{i}" for i in range(HASHED)))


def hashed_places(words):
    """Of each text: the shares of its words in each place, and of its runs of four bytes."""
    import numpy as np

    n = len(words.size)
    by_word = np.bincount(words.doc_of_word() * HASHED + (words.hashes >> np.uint64(40)).astype(np.int64) % HASHED, minlength=n * HASHED)[: n * HASHED].reshape(n, HASHED)
    buf = words.buf.astype(np.uint32)
    runs = buf[:-3] << 24 | buf[1:-2] << 16 | buf[2:-1] << 8 | buf[3:] if len(buf) > 3 else buf[:0]
    place = ((runs * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64) % HASHED
    text_of = np.repeat(np.arange(n), words.size + 1)[: len(runs)]  # a text's own bytes, and the line end after it
    inside = np.arange(len(runs)) + 4 <= (words.at + words.size)[text_of]
    by_run = np.bincount(text_of[inside] * HASHED + place[inside], minlength=n * HASHED)[: n * HASHED].reshape(n, HASHED)
    return by_word / np.maximum(1, by_word.sum(1, keepdims=True)), by_run / np.maximum(1, by_run.sum(1, keepdims=True))


def features(texts: list[str | None]):
    """A row of FEATURES for each text."""
    import numpy as np

    from millrace.llm.words import Words, chunks, duplicate_lines, repeated_words

    rows = np.zeros((len(texts), len(FEATURES)))
    upper = np.zeros(256, bool)
    upper[65:91] = True
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    digit = np.zeros(256, bool)
    digit[48:58] = True
    letter = np.zeros(256, bool)
    letter[97:123] = letter[65:91] = True
    for first, part in chunks((t or "").encode() for t in texts):
        w = Words(part)
        n_words = np.diff(w.bounds)
        some, size = np.maximum(1, n_words), np.maximum(1, w.size)
        lead = (w.buf & 0xC0) != 0x80
        letters = w.per_text(letter[w.buf] | (w.buf >= 0xC0))
        # an upper-case two-byte letter (Latin-1 range) has 0xC3 and then 0x80-0x9E
        wide = np.concatenate([[False], (w.buf[:-1] == 0xC3) & (w.buf[1:] >= 0x80) & (w.buf[1:] <= 0x9E)])
        caps = w.per_text(upper[w.buf] | wide) / np.maximum(1, letters)
        symbols = w.per_text(symbol[w.buf]) / size
        lengths = w.ends - w.starts
        docs = w.doc_of_word()
        keys = w.hashes ^ (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at, counts = np.unique(keys, return_index=True, return_counts=True)
        distinct = np.bincount(docs[at], minlength=len(part))
        top = np.zeros(len(part))
        np.maximum.at(top, docs[at], counts)
        repeated = repeated_words(w) / some
        lines = np.array([duplicate_lines(t) for t in part], float).reshape(-1, 2)
        bits = np.zeros(len(part))
        for i, t in enumerate(part):
            c = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
            p = c[c > 0] / max(1, len(t))
            bits[i] = -(p * np.log2(p)).sum()
        rows[first : first + len(part)] = np.column_stack([
            np.log1p(n_words), np.log1p(n_words) ** 2, 1 / np.sqrt(1 + n_words), w.per_text(lead & ~w.space) / some, np.bincount(docs, lengths > 20, len(part)) / some, caps, np.sqrt(caps), symbols, np.sqrt(symbols),
            w.per_text(w.buf == 33) / size, w.per_text(digit[w.buf]) / size, w.per_text(w.buf == 124) / some, w.per_text(w.buf >= 0x80) / size,
            w.per_text(w.buf == 46) / some, w.per_text(w.buf == 44) / some, lines[:, 0] / some, repeated, np.sqrt(repeated), lines[:, 1] / np.maximum(1, lines[:, 0]),
            distinct / some, top / some, bits, *hashed_places(w),
        ])
    return rows


@dataclass(frozen=True)
class Ranking:
    """mean and scale of the features, their weights, and the threshold of raw scores."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float

    def scores(self, rows):
        import numpy as np

        raw = ((rows - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold, -30, 30)))


def _constant(label: int) -> Ranking:
    n = len(FEATURES)
    return Ranking([0.0] * n, [1.0] * n, [0.0] * n, -5.0 if label else 5.0)


def _slopes(x, over, under, w):
    """Gradient and curvature of the logistic loss of pairs, as sums."""
    import numpy as np

    gradient, curvature = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for i in range(0, len(over), PAIRS_AT_ONCE):
        d = x[over[i : i + PAIRS_AT_ONCE]] - x[under[i : i + PAIRS_AT_ONCE]]
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient -= d.T @ p
        curvature += (d * (p * (1 - p))[:, None]).T @ d
    return gradient, curvature


def _minimised(slopes, size: int):
    """The weights at the least ridge-penalised loss, by Newton steps; slopes(w): pairs, gradient and curvature."""
    import numpy as np

    w = np.zeros(size)
    for _ in range(30):
        pairs, gradient, curvature = slopes(w)
        step = np.linalg.solve(RIDGE * np.eye(size) + curvature / pairs, RIDGE * w + gradient / pairs)
        w -= step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(rows, labels, shares: dict[int, float], pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """The ranking of rows at hand, with drawn pairs; shares: of each label among all labelled rows."""
    import numpy as np

    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return _constant(int(not len(bad)))
    mean, scale = rows.mean(0), rows.std(0)
    scale[scale < 1e-9] = 1.0
    scale[len(MEASURES) :] /= HASHED_WEIGHT
    x = (rows - mean) / scale
    rng = np.random.default_rng(seed)
    over, under = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = _minimised(lambda w: (pairs, *_slopes(x, over, under, w)), x.shape[1])
    raw = x @ w
    weight = np.where(labels == 1, shares[1] / len(good), shares[0] / len(bad))
    order = np.argsort(raw)
    at = np.searchsorted(np.cumsum(weight[order]) / weight.sum(), shares[0] / (shares[0] + shares[1]))
    at = int(np.clip(at, 1, len(order) - 1))
    return Ranking(mean.tolist(), scale.tolist(), w.tolist(), float((raw[order[at - 1]] + raw[order[at]]) / 2))


def with_features(docs: DataFrame, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the carried columns and features (array of doubles) for each row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = features(batch.column("text").to_pylist())
            rest = batch.drop_columns(["text"])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, lists], [*rest.schema.names, "features"])

    return plain.mapInArrow(measure, ", ".join([f"`{n}` {t}" for n, t in plain.drop("text").dtypes] + ["features array<double>"]))


BLOCK = "n int, labels binary, own binary, rows binary"


def blocks(found: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """BLOCK of found (features, quality, at: a hash): labels, whether a row is here for itself or as one more copy for pairs, and features (floats)."""
    n, rare = sum(sizes.values()), min(sizes, key=lambda q: (sizes[q], q))
    many = max(1, -(-n // BLOCK_ROWS))
    copies = min(many, max(1, -(-RARE_ROWS * many // sizes[rare])))
    places = F.sequence(F.lit(0), F.when(F.col("quality") == rare, copies - 1).otherwise(0))
    dealt = found.select("*", F.explode(places).alias("copy")).withColumn("block", F.pmod(F.pmod("at", F.lit(many)) + F.col("copy"), F.lit(many)))

    def packed(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by([("at", "ascending"), ("copy", "ascending")])
        rows = np.asarray(t["features"].combine_chunks().flatten(), "<f4")
        put = lambda v: pa.array([v.tobytes()], pa.binary())
        return pa.table({"n": pa.array([len(t)], pa.int32()), "labels": put(t["quality"].to_numpy().astype(np.int8)), "own": put((t["copy"].to_numpy() == 0).astype(np.int8)), "rows": put(rows)})

    return dealt.select("block", "at", "copy", "quality", F.col("features").cast("array<float>").alias("features")).groupBy("block").applyInArrow(packed, BLOCK)


def _summed(packed: DataFrame, make) -> list:
    """The sums over all blocks of the arrays that make(labels, own, rows) gives, of each task's sums."""
    import numpy as np

    def partial(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        whole = None
        for batch in batches:
            for i in range(len(batch)):
                labels, own = (np.frombuffer(batch.column(c)[i].as_py(), np.int8) for c in (1, 2))
                some = make(labels, own == 1, np.frombuffer(batch.column(3)[i].as_py(), "<f4").reshape(len(labels), -1))
                whole = some if whole is None else [a + b for a, b in zip(whole, some, strict=True)]
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(whole)], pa.binary())], ["sums"])

    import pickle

    whole = None
    for row in packed.mapInArrow(partial, "sums binary").toLocalIterator(prefetchPartitions=True):
        some = pickle.loads(row["sums"])
        whole = some if whole is None else [a + b for a, b in zip(whole, some, strict=True)]
    return whole


def _paired(labels):
    """Of a block's rows: those over and those under, pair by pair."""
    import numpy as np

    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    most, least = (good, bad) if len(good) >= len(bad) else (bad, good)
    if not len(least):
        return least, least
    most = np.tile(most, PARTNERS)
    rng = np.random.default_rng(len(labels))
    others = rng.permutation(np.resize(rng.permutation(least), len(most)))
    return (most, others) if len(good) >= len(bad) else (others, most)


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """The ranking learnt from all labels (doc_id, quality) of docs (doc_id, text)."""
    import numpy as np

    from millrace.frame import OrderedFrame
    from millrace.llm.shared import scratch, stash
    from millrace.positions import numbered

    with scratch(docs.sparkSession):
        known = stash(labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.min("quality").cast("int").alias("quality")), "labels")
        n = known.count()
        if not n:
            return _constant(1)
        at = F.xxhash64("text", "doc_id").alias("at")
        if n <= BROADCAST_LABELS:
            found = with_features(docs.join(F.broadcast(known), docs["doc_id"] == known["_labelled"]), (F.col("quality"), at))
        else:
            found = with_features(docs, (at,)).join(known, F.col("doc_id") == F.col("_labelled"))
        found = stash(found.select("quality", "at", F.col("features").cast("array<float>").alias("features")), "quality-features")
        sizes = {q: m for q, m in found.groupBy("quality").count().collect()}
        if len(sizes) < 2:
            return _constant(max(sizes, default=1))
        packed = stash(blocks(found, sizes), "quality-blocks")

        def moments(labels, own, rows):
            x = rows[own].astype(float)
            return [np.array([len(x)], float), x.sum(0)]

        (m,), total = _summed(packed, moments)
        mean = total / m
        scale = np.sqrt(_summed(packed, lambda labels, own, rows: [((rows[own] - mean) ** 2).sum(0)])[0] / m)
        scale[scale < 1e-9] = 1.0
        scale[len(MEASURES) :] /= HASHED_WEIGHT

        def slopes(w):
            def make(labels, own, rows):
                over, under = _paired(labels)
                return [np.array([len(over)], float), *_slopes((rows - mean) / scale, over, under, w)]

            (pairs,), gradient, curvature = _summed(packed, make)
            return pairs, gradient, curvature

        w = _minimised(slopes, len(mean))

        def raws(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for i in range(len(batch)):
                    own = np.frombuffer(batch.column(2)[i].as_py(), np.int8) == 1
                    rows = np.frombuffer(batch.column(3)[i].as_py(), "<f4").reshape(len(own), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(((rows[own] - mean) / scale) @ w)], ["raw"])

        raw = stash(packed.mapInArrow(raws, "raw double"), "quality-scores")
        place = int(np.clip(sizes[0], 1, int(m) - 1))
        beside = [r[0] for r in numbered(OrderedFrame.of(raw, "raw")).where(F.col("pos").between(place - 1, place)).select("raw").collect()]
        return Ranking(mean.tolist(), scale.tolist(), w.tolist(), sum(beside) / 2)


def score(docs: DataFrame, ranking: Ranking, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, score and predicted for each row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = ranking.scores(features(batch.column("text").to_pylist()))
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found), pa.array((found >= 0.5).astype("int32"))], [*rest.schema.names, "score", "predicted"])

    return plain.mapInArrow(judge, ", ".join([f"`{n}` {t}" for n, t in plain.drop("text").dtypes] + ["score double, predicted int"]))
