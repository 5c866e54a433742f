"""Operator 10, quality rules: counts of a text and n-gram perplexity bands.

The language model is a modified Kneser-Ney model of n-grams of ORDER bytes, about a word and
the next one's beginning, one for each language and fold. A text is judged by a model that
doesn't hold it: a hash of the text puts it in one of two folds, and the model of a fold is
counted over the texts of the other, copies of a text once (they share its fold). So what
nobody else writes is unlikely, however often the text itself has it.

Spark counts the n-grams of each fold over all texts; continuation counts of the lower orders,
discounts and the sums of contexts are aggregations of that table. What remains are two kinds of
numbers in one table: an n-gram's discounted count, and a context's count and discounted mass.
They stand in arrays sorted by the hashes of n-grams and contexts and searched by bisection; a
probability is made of them in the task, order by order, so n-grams that were never seen back
off to shorter ones. The table grows with the corpus. Up to BROADCAST_ENTRIES of a fold the
arrays go to every task; beyond that they are dealt by hash: a block of texts sends each
different n-gram and context once to the part that has it, and gets the numbers back.

A text's perplexity is per byte of its whole text. The bands of a language are drawn around the
shortest interval of log-perplexity that holds half of its distinct texts that pass the base
rules: its middle plus and minus multiples of its half length. Junk of any kind doesn't move
them while it is less than half.

Defined cases: null and empty texts have no words and fail the base rules; a null lang is a
language of its own; rows that repeat are judged each for itself, and count once in the model
(those that share their doc_id too, each) and once for the bands; where a language's texts are
all in one fold, all bytes are as likely; a probability is LEAST at least; a text of any length
is counted and scored whole, a part at a time; of intervals that are as short the lowest is
taken, and a text on a band's limit stays; bands are at least LEAST_SPREAD times their multiple
wide; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stash

ORDER = 6
SYMBOLS = 257  # bytes, and the end of a text
#: Kinds of keys, beside the order: a key has the n-gram's or context's bytes below.
GRAM, CONTEXT = 0, 8
START, END = 0xFF, 0xFE  # bytes that no UTF-8 text has
#: The least probability: a context of frequent n-grams alone may leave no mass for others.
LEAST = 2.0**-40
#: n-grams a task holds before it passes their counts on, and bytes of texts for each such task.
HELD_GRAMS, COUNTED_BYTES = 2 << 20, 64 << 20
#: A held n-gram is one number: its count stands in so many bits below its bytes.
COUNT_BITS = 64 - 8 * ORDER
MOST_COUNTED = (1 << COUNT_BITS) - 1
#: Bytes of texts whose n-grams are made at once, and whose costs are: some 150 bytes of memory each.
COUNTED_AT_ONCE, SCORED_AT_ONCE = 1 << 19, 1 << 19
#: Languages whose discounts (a row each) may go to every task; beyond it they are joined.
BROADCAST_LANGS = 10_000
#: n-grams and contexts of a fold's models that may go to every task whole (some 5 bytes each on their way, 16 there).
BROADCAST_ENTRIES = 6_000_000
#: Texts that are scored at once.
ROWS_AT_ONCE = 1000
#: Texts with copies (20 bytes each) that may go to every task; beyond it they are joined.
BROADCAST_COPIES = 1_000_000
#: Bytes of text in a block, and entries of a part of the model, where they are dealt.
BLOCK_BYTES, PART_ENTRIES = 32 << 20, 1_000_000
#: Multiples of half the shortest half; 10 is 6.7 standard deviations of a normal spread. Short
#: texts and those that share passages with others lie farther out than a normal spread has them.
BELOW, ABOVE = 10.0, 10.0
#: Bins of log-perplexity in a bit.
BINS = 1000
#: The least spread, in bits.
LEAST_SPREAD = 0.01

#: A model in parts: languages, folds, and n keys (as steps) with their numbers, compressed.
PACKED = "lang string, fold int, n long, keys binary, x binary, y binary"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double"


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def grams(texts: list[bytes]):
    """The n-grams of texts, and the text of each; one for each byte and each text's end."""
    import numpy as np

    pad = bytes([START]) * (ORDER - 1)
    joined = b"".join(pad + t + bytes([END]) for t in texts)
    buf = np.frombuffer(joined, np.uint8)
    out = np.zeros(max(0, len(buf) - ORDER + 1), np.int64)
    for j in range(ORDER):
        out = (out << 8) | buf[j : j + len(out)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return out[buf[ORDER - 1 :] != START], sizes


def _tallied(held: list):
    """Arrays of n-grams with their counts below them as one, sorted and each n-gram once; a count that doesn't fit has several."""
    import numpy as np

    entries = np.concatenate(held)
    entries.sort()
    steps = entries[1:] ^ entries[:-1]
    steps >>= np.uint64(COUNT_BITS)
    starts = np.concatenate([[0], np.flatnonzero(steps) + 1])
    del steps
    n = np.add.reduceat(entries & np.uint64(MOST_COUNTED), starts).astype(np.int64)
    own = entries[starts] >> np.uint64(COUNT_BITS)
    if n.max() > MOST_COUNTED:
        times = -(-n // MOST_COUNTED)
        own, last, left = np.repeat(own, times), np.cumsum(times) - 1, n - (times - 1) * MOST_COUNTED
        n = np.full(len(own), MOST_COUNTED)
        n[last] = left
    own <<= np.uint64(COUNT_BITS)
    own |= n.astype(np.uint64)
    return own


def counted(batches: Iterator) -> Iterator:
    """lang, fold, gram, n of batches of lang, fold, text: an n-gram may come several times."""
    import numpy as np
    import pyarrow as pa

    from millrace.llm.words import chunks

    _HELD.clear()  # what an earlier job's tasks have left
    held: dict[tuple, list] = {}

    def flush() -> Iterator:
        for lang, fold in sorted(held):
            entries = _tallied(held.pop((lang, fold)))
            for i in range(0, len(entries), 1 << 16):
                part = entries[i : i + (1 << 16)]
                grams_of, n = (x.astype(np.int64) for x in (part >> np.uint64(COUNT_BITS), part & np.uint64(MOST_COUNTED)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([fold] * len(part), pa.int32()), pa.array(grams_of), pa.array(n)], ["lang", "fold", "gram", "n"])

    def n_held() -> int:
        return sum(len(k) for parts in held.values() for k in parts)

    # a batch of long texts has many times HELD_GRAMS: so the bound holds within it too
    for batch in (whole.slice(i, ROWS_AT_ONCE) for whole in batches for i in range(0, len(whole), ROWS_AT_ONCE)):
        by_model: dict[tuple, list[bytes]] = {}
        for lang, fold, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            by_model.setdefault((lang, fold), []).append((text or "").encode())
        for key, texts in by_model.items():
            for _, part in chunks(texts, COUNTED_AT_ONCE):
                found = grams(part)[0].view(np.uint64)
                found <<= np.uint64(COUNT_BITS)
                found |= np.uint64(1)
                held.setdefault(key, []).append(_tallied([found]))
                del found
                if len(held[key]) >= 16:
                    held[key] = [_tallied(held[key])]
                if n_held() > HELD_GRAMS:
                    for x in held:
                        held[x] = [_tallied(held[x])]
                    if n_held() > HELD_GRAMS // 2:
                        yield from flush()
    yield from flush()
    pa.default_memory_pool().release_unused()  # the worker stays while Spark sums the counts


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, fold, gram, n over all texts of docs (lang, fold, text)."""
    # tasks that see more texts pass fewer counts on; partitions are put together, not dealt anew
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, size // COUNTED_BYTES)
    found = docs.select("lang", "fold", "text").coalesce(tasks).mapInArrow(counted, "lang string, fold int, gram long, n long")
    return found.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


def _fold(content: Column) -> Column:
    return F.pmod(content, F.lit(2)).cast("int")


def once(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text) with one of the copies of each text, the others gone. Texts don't move."""
    rows = docs.select(_language().alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_content"), F.xxhash64("doc_id").alias("_own"))
    copies = rows.groupBy(F.col("lang").alias("_lang"), F.col("_content").alias("_same")).agg(F.count("*").alias("_n"), F.min("_own").alias("_first")).where("_n > 1").drop("_n")
    copies = stash(copies, "copies")
    few = copies.count() <= BROADCAST_COPIES
    joined = rows.join(F.broadcast(copies) if few else copies, (F.col("lang") == F.col("_lang")) & (F.col("_content") == F.col("_same")), "left")
    return joined.where("_first is null or _first = _own").select("lang", _fold(F.col("_content")).alias("fold"), "text")


def model(docs: DataFrame) -> DataFrame:
    """PACKED of docs (lang, fold, text): the discounted count (x) of each n-gram, and count and mass (x, y) of each context."""
    keys = ["lang", "fold"]
    orders = {ORDER: stash(count_grams(docs), "gram-counts")}
    for size in range(ORDER - 1, 0, -1):
        orders[size] = orders[size + 1].groupBy(*keys, F.col("gram").bitwiseAND((1 << 8 * size) - 1).alias("gram")).agg(F.count("*").alias("n"))
    # each order's exchange is made once and used by the next order too
    every = [t.select(*keys, F.lit(size).alias("size"), "gram", F.col("n").cast("long").alias("n")) for size, t in orders.items()]
    grams_of = stash(functools.reduce(DataFrame.unionByName, every), "gram-orders")
    ones = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    discounts = [F.least(F.lit(float(i)), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((i + 1) * y * F.col(f"n{i + 1}"), F.col(f"n{i}").cast("double")) * -1 + i, F.lit(0.5 * i)))).alias(f"d{i}") for i in (1, 2, 3)]
    of_models = stash(grams_of.groupBy(*keys, "size").agg(*ones).select(*keys, "size", *discounts), "discounts")
    t = grams_of.join(F.broadcast(of_models) if of_models.count() <= BROADCAST_LANGS else of_models, [*keys, "size"])
    t = t.withColumn("off", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    key = lambda kind, gram: F.shiftleft((F.col("size") + kind).cast("long"), 48).bitwiseOR(gram).alias("key")
    counts = t.select(*keys, key(GRAM, F.col("gram")), (F.col("n") - F.col("off")).cast("float").alias("x"), F.lit(0.0).cast("float").alias("y"))
    contexts = t.groupBy(*keys, key(CONTEXT, F.shiftright("gram", 8))).agg(F.sum("n").cast("float").alias("x"), F.sum("off").cast("float").alias("y"))
    # each partition packs what it has: keys in any number of ranges are sorted where they are used
    rows = counts.unionByName(contexts).sortWithinPartitions(*keys, "key")
    return stash(rows.mapInArrow(_pack, PACKED), "model")


def _planes(values) -> bytes:
    """Numbers, their first bytes together, their second bytes together and so on, compressed."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _numbers(data: bytes, n: int, kind: str):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel()


def _pack(batches: Iterator) -> Iterator:
    """Rows (lang, fold, key, x, y), sorted, as PACKED: the steps of PART_ENTRIES keys at most, and their numbers."""
    import numpy as np
    import pyarrow as pa

    at, held, n_held = None, [], 0

    def part():
        keys, x, y = (np.concatenate([h[i] for h in held]) for i in range(3))
        steps = np.diff(keys, prepend=0).astype("<i8")
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([len(keys)], pa.int64()), *(pa.array([_planes(c)], pa.binary()) for c in (steps, x.astype("<f4"), y.astype("<f4")))], [c.split()[0] for c in PACKED.split(", ")])

    for batch in batches:
        of = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        cuts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
        columns = [batch.column(i).to_numpy() for i in (2, 3, 4)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and (of[a] != at or n_held >= PART_ENTRIES):
                yield part()
                held, n_held = [], 0
            at = of[a]
            held.append([c[a:b] for c in columns])
            n_held += b - a
    if held:
        yield part()


def _unpacked(row) -> tuple:
    """keys, x and y of a row of PACKED."""
    import numpy as np

    keys, x, y = (_numbers(row[c], row["n"], kind) for c, kind in (("keys", "<i8"), ("x", "<f4"), ("y", "<f4")))
    return np.cumsum(keys), x, y


class Model:
    """A language's n-grams and contexts, as arrays sorted by the hashes of their keys, and their numbers."""

    def __init__(self, keys, x, y):
        import numpy as np

        hashes = self.hashed(np.asarray(keys))
        order = np.argsort(hashes)
        self.hashes, self.x, self.y = hashes[order], np.asarray(x, np.float32)[order], np.asarray(y, np.float32)[order]

    @classmethod
    def of(cls, rows: list) -> Model:
        """The model of some rows of PACKED, unpacked a column at a time."""
        import numpy as np

        made = cls(np.zeros(0, np.int64), [], [])
        hashes = np.concatenate([cls.hashed(np.cumsum(_numbers(r["keys"], r["n"], "<i8"))) for r in rows])
        order = np.argsort(hashes)
        made.hashes = hashes[order]
        del hashes
        made.x = np.concatenate([_numbers(r["x"], r["n"], "<f4") for r in rows])[order]
        made.y = np.concatenate([_numbers(r["y"], r["n"], "<f4") for r in rows])[order]
        return made

    @staticmethod
    def hashed(keys):
        import numpy as np

        from millrace.llm.words import mix

        return mix(keys.astype(np.uint64))

    def find(self, keys):
        """The numbers of keys, 0 where there is none."""
        import numpy as np

        out = np.zeros((2, len(keys)))
        if len(self.hashes):
            wanted = self.hashed(keys)
            order = np.argsort(wanted)  # neighbours are found near each other
            wanted = wanted[order]
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            known = self.hashes[at] == wanted
            out[:, order[known]] = self.x[at[known]], self.y[at[known]]
        return out


#: The models that a worker has made last, and of what: tasks that come after have the same.
_HELD: dict = {}


def _models(token: str, packed: list) -> dict[str, Model]:
    """Models by language of rows of PACKED."""
    if token not in _HELD:
        _HELD.clear()
        by_lang: dict[str, list] = {}
        for row in packed:
            by_lang.setdefault(row["lang"], []).append(row)
        _HELD[token] = {lang: Model.of(rows) for lang, rows in by_lang.items()}
    return _HELD[token]


def _orders(found):
    """(order, its different n-grams, of which each n-gram of the order above is the suffix), from the highest down."""
    import numpy as np

    own, each = np.unique(found, return_inverse=True)
    for size in range(ORDER, 0, -1):
        yield size, own, each
        own, each = np.unique(own & ((1 << 8 * (size - 1)) - 1), return_inverse=True)


def _keys(kind: int, size: int, own):
    return own | ((size + kind) << 48)


def wanted(found):
    """The keys that the costs of n-grams are made of."""
    import numpy as np

    return np.concatenate([k for size, own, _ in _orders(found) for k in (_keys(GRAM, size, own), np.unique(_keys(CONTEXT, size, own >> 8)))])


def cost(found, numbers: Model):
    """Bits of each n-gram of found."""
    import numpy as np

    orders = list(_orders(found))
    p = np.full(1, 1.0 / SYMBOLS)
    below = np.zeros(len(orders[-1][1]), np.int64)  # of each n-gram of the lowest order: the empty one
    for i in range(len(orders) - 1, -1, -1):
        size, own, each = orders[i]
        contexts, of = np.unique(own >> 8, return_inverse=True)
        count = numbers.find(_keys(GRAM, size, own))[0]
        whole, mass = numbers.find(_keys(CONTEXT, size, contexts))[:, of]
        lower = p[below]
        p = np.maximum(LEAST, np.where(whole > 0, (count + mass * lower) / np.where(whole > 0, whole, 1), lower))
        below = each
    return -np.log2(p)[below]


def _measured(texts: list[str | None], langs: list[str], models: dict[str, Model]) -> list:
    """Columns of BASE for texts; bits: of a byte, on average."""
    import numpy as np

    from millrace.llm.words import Words, chunks, duplicate_lines, repeated_words

    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    raw = [(t or "").encode() for t in texts]
    out: list[list] = [[] for _ in range(5)]
    for _, part in chunks(raw):
        w = Words(part)
        out[0] += np.diff(w.bounds).tolist()
        out[1] += w.per_text(((w.buf & 0xC0) != 0x80) & ~w.space).tolist()
        out[2] += w.per_text(symbol[w.buf]).tolist()
        out[3] += [duplicate_lines(t)[1] for t in part]
        out[4] += repeated_words(w).tolist()
    bits = np.zeros(len(raw))
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    for lang, rows in by_lang.items():
        numbers = models.get(lang) or Model(np.zeros(0, np.int64), [], [])
        for first, part in chunks((raw[i] for i in rows), SCORED_AT_ONCE):
            found, sizes = grams(part)
            ends = np.cumsum(sizes)
            total = np.add.reduceat(cost(found, numbers), ends - sizes)
            bits[rows[first : first + len(part)]] = total / sizes
    return [*out, bits.tolist()]


def _columns_of(texts: list, langs: list, models: dict[str, Model]) -> list:
    import pyarrow as pa

    kinds = [pa.int64()] * 5 + [pa.float64()]
    return [pa.array(c, k) for c, k in zip(_measured(texts, langs, models), kinds, strict=True)]


NAMES = ["doc_id", "lang", "content", *(x.split()[0] for x in BASE.split(", "))]
MEASURED = f"doc_id long, lang string, content long, {BASE}"


def measure(docs: DataFrame, numbers: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """doc_id, lang, content (hash of the text) and BASE for each row of docs, by the model (of model()) of its lang and the other fold."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _language().alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("content"))
    ways = []
    for fold in (0, 1):  # a task holds the models of one fold
        texts, own = plain.where(_fold(F.col("content")) == fold), numbers.where(F.col("fold") == 1 - fold).drop("fold")
        n = own.agg(F.sum("n")).first()[0] or 0
        ways.append(_measured_by_key(texts, own, n) if n > broadcast_entries else _measured_by_all(texts, own))
    return ways[0].unionByName(ways[1])


def _measured_by_all(plain: DataFrame, numbers: DataFrame) -> DataFrame:
    """measure() by models that go to every task, packed: some 5 bytes an entry, 30 MB at the bound."""
    packed = [r.asDict() for r in numbers.toLocalIterator()]
    shared, token = plain.sparkSession.sparkContext.broadcast(packed), uuid.uuid4().hex
    del packed

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = _models(token, shared.value)
        for whole in batches:
            for i in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(i, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *_columns_of(batch.column(2).to_pylist(), batch.column(1).to_pylist(), found)], NAMES)

    return plain.mapInArrow(scored, MEASURED)


def _prime(n: int) -> int:
    """The first prime from n on."""
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _measured_by_key(plain: DataFrame, numbers: DataFrame, n_entries: int) -> DataFrame:
    """measure() by models in parts: the keys with one remainder are a part's."""
    parts = _prime(max(7, -(-n_entries // PART_ENTRIES)))
    kept = plain.select("doc_id", "lang", "text", "content", F.spark_partition_id().cast("long").alias("part"))
    asked_columns = "of long, key_lang string, key_part int, keys binary"

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from millrace.llm.words import chunks

        own_names, names = ["block", "doc_id", "lang", "text", "content"], [x.split()[0] for x in asked_columns.split(", ")]
        own_kinds, kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], [pa.int64(), pa.string(), pa.int32(), pa.binary()]
        n_blocks, size, block = 0, 0, 0
        held: dict[str, list] = {}

        def entries() -> Iterator:
            for lang in sorted(held):
                found = np.unique(np.concatenate(held[lang]))
                place = found % parts
                order = np.argsort(place, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                    row = [pa.array([block]), pa.array([lang]), pa.array([int(place[some[0]])], pa.int32()), pa.array([found[some].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in own_kinds), *row], own_names + names)
            held.clear()

        for batch in batches:
            langs, raw = batch.column(1).to_pylist(), [(t or "").encode() for t in batch.column(2).to_pylist()]
            first = 0
            for i, t in enumerate(raw):
                size += len(t) + 1
                if size >= BLOCK_BYTES or i + 1 == len(raw):
                    block = (batch.column(4)[0].as_py() << 24) + n_blocks
                    by_lang: dict[str, list[bytes]] = {}
                    for lang, x in zip(langs[first : i + 1], raw[first : i + 1], strict=True):
                        by_lang.setdefault(lang, []).append(x)
                    for lang, texts in by_lang.items():
                        for _, part in chunks(texts):
                            held.setdefault(lang, []).append(np.unique(wanted(grams(part)[0])))
                    rows = batch.slice(first, i + 1 - first).drop_columns(["part"])
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows)), *rows.columns, *(pa.nulls(len(rows), k) for k in kinds)], own_names + names)
                    first = i + 1
                    if size >= BLOCK_BYTES:
                        yield from entries()
                        n_blocks, size = n_blocks + 1, 0
        if held:
            yield from entries()

    cut_up = stash(kept.mapInArrow(cut, f"block long, doc_id long, lang string, text string, content long, {asked_columns}"), "rule-blocks")
    entries = cut_up.where("of is not null").select(*(x.split()[0] for x in asked_columns.split(", ")))

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                keys, x, y = _unpacked(row)
                for i in range(0, len(keys), 1 << 16):
                    columns = [c[i : i + (1 << 16)] for c in (keys, x, y)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(columns[0]), pa.string()), *map(pa.array, columns)], ["model_lang", "key", "x", "y"])

    dealt = numbers.mapInArrow(unpack, "model_lang string, key long, x float, y float").withColumn("model_part", F.pmod("key", F.lit(parts)).cast("int"))

    def answer(asked, own):
        import numpy as np
        import pyarrow as pa

        part = Model(*(own[c].to_numpy() for c in ("key", "x", "y")))
        found = [part.find(np.frombuffer(x, "<i8")) for x in asked["keys"].to_pylist()]
        put = lambda i: pa.array([f[i].astype("<f4").tobytes() for f in found], pa.binary())
        return pa.table({"of": asked["of"], "key_lang": asked["key_lang"], "keys": asked["keys"], "x": put(0), "y": put(1)})

    answers = entries.groupBy("key_lang", "key_part").cogroup(dealt.groupBy("model_lang", "model_part")).applyInArrow(answer, "of long, key_lang string, keys binary, x binary, y binary")

    def score(texts, own):
        import numpy as np
        import pyarrow as pa

        by_lang: dict[str, list] = {}
        for lang, k, x, y in zip(*(own[c].to_pylist() for c in ("key_lang", "keys", "x", "y")), strict=True):
            by_lang.setdefault(lang, []).append((np.frombuffer(k, "<i8"), np.frombuffer(x, "<f4"), np.frombuffer(y, "<f4")))
        models = {lang: Model(*map(np.concatenate, zip(*found, strict=True))) for lang, found in by_lang.items()}
        return pa.table([texts["doc_id"], texts["lang"], texts["content"], *_columns_of(texts["text"].to_pylist(), texts["lang"].to_pylist(), models)], names=NAMES)

    texts = cut_up.where("block is not null").select("block", "doc_id", "lang", "text", "content")
    return texts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(score, MEASURED)


def _shortest_half(bins: list[int], counts: list[int]) -> tuple[int, int]:
    """The first shortest interval of bins (ascending) that holds half of the counts or more."""
    most, best, held, a = -(-sum(counts) // 2), (bins[0], bins[-1]), 0, 0
    for b, n in enumerate(counts):
        held += n
        while held - counts[a] >= most:
            held, a = held - counts[a], a + 1
        if held >= most and bins[b] - bins[a] < best[1] - best[0]:
            best = (bins[a], bins[b])
    return best


def bands(measured: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """lang, low and high: limits of bits, from the shortest half of all distinct texts that pass the base rules."""
    distinct = measured.where(~F.col("base_failed")).groupBy("lang", "content").agg(F.min("bits").alias("bits"))
    # as many rows a language as there are bins: -log2(LEAST) * BINS at most
    binned = distinct.groupBy("lang", F.round(F.col("bits") * BINS).cast("long").alias("bin")).agg(F.count("*").alias("n"))

    def limits(t):
        import pyarrow as pa

        rows = sorted(zip(t["bin"].to_pylist(), t["n"].to_pylist(), strict=True))
        a, b = _shortest_half([x for x, _ in rows], [n for _, n in rows])
        middle, half = (a + b) / 2, max((b - a) / 2, LEAST_SPREAD * BINS)
        return pa.table({"_lang": t["lang"][:1], "low": [round(middle - below * half) / BINS], "high": [round(middle + above * half) / BINS]})

    return binned.groupBy("lang").applyInArrow(limits, "_lang string, low double, high double")


def judge(docs: DataFrame, below: float = BELOW, above: float = ABOVE, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """The counts, perplexity and verdict of each row of docs (doc_id, text, lang)."""
    # copies of a text count once, in the model as in the bands: else they'd make themselves likely
    found = measure(docs, model(once(docs)), broadcast_entries)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = stash(found.withColumn("base_failed", failed), "measured")
    limits = bands(found, below, above)
    inside = F.coalesce((F.round(F.col("bits") * BINS) / BINS).between(F.col("low"), F.col("high")), F.lit(True))
    return (
        found.join(limits, F.col("lang") == F.col("_lang"), "left")
        .withColumn("kept", ~F.col("base_failed") & inside)
        .withColumn("perplexity", F.pow(F.lit(2.0), F.col("bits")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "low", "high", "lang")
    )
