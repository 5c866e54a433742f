"""Operator 9, byte-level BPE encoding and decoding by a file of ranks.

Encoding. Each different piece of text is worked on once (see pieces.py): a bucket's pieces
are cut into words, the matches of a pattern. A word in the vocabulary is a token; all
other distinct words are encoded by Spark's higher-order functions: a fold over a word's
byte array merges, in each step, the leftmost pair of lowest rank, looked up in a literal
rank map. Pieces get their words' ids, and blocks put their texts' ids together.

A fold takes time with the square of a word's length, so words of more than WIDTH bytes are
folded in windows that overlap. A row of tokens is a word's encoding if each two neighbours
are that of their bytes, as they are in any encoding that has them side by side; so two
windows that have a token of their overlap in common are the word's encoding on either side
of it. Where two windows share none (hardly ever outside of runs of one character), the word
is merged by a heap instead.

Decoding concatenates the vocabulary's binary pieces.

Defined cases: a null or empty text has no ids; rows that repeat are encoded each for
itself; a null doc_id is carried; texts and words may be of any length, at a cost in
proportion to it; ties of rank go to the leftmost pair; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import pieces

#: Bits of a rank in the rank map's entries.
RANK_BITS = 18
#: Bytes of a window of a long word, and from one window's start to the next's.
WIDTH, STEP = 192, 128
#: Factors of the places that a pair may have in the rank map.
FIRST, SECOND = (7919, 104729), (15485863, 32452843)


@lru_cache(2)
def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a file of lines 'base64 rank', in the order of ranks from 0."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks are 0, 1, 2 and so on")
    return [found[i] for i in range(len(found))]


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(read_ranks(path))}


def _prime(n: int) -> int:
    """The first prime from n on."""
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@lru_cache(2)
def rank_map(path: str) -> tuple[list[int], list[int]]:
    """The ranks of the 256 bytes, and the rank map.

    The map has an entry for each pair of ranks that merges: the two ranks and the merged
    one, RANK_BITS each. An entry is at one of its two places; free places have -1.
    """
    of = _ranks(path)
    if len(of) >> RANK_BITS:
        raise ValueError("too many ranks")
    pairs = [(of[t[:i]], of[t[i:]], r) for t, r in of.items() for i in range(1, len(t)) if t[:i] in of and t[i:] in of]
    size = _prime(max(1000, int(len(pairs) * 2.5)))
    while True:
        table: list[tuple | None] = [None] * size
        stuck = False
        for own in pairs:
            entry: tuple | None = own
            place = (own[0] * FIRST[0] + own[1] * FIRST[1]) % size
            for _ in range(500):  # who is in the place moves to its other one
                entry, table[place] = table[place], entry
                if entry is None:
                    break
                first, second = ((entry[0] * m + entry[1] * n) % size for m, n in (FIRST, SECOND))
                place = second if place == first else first
            stuck |= entry is not None
        if not stuck:
            break
        size = _prime(size + 1000)
    return [of[bytes([i])] for i in range(256)], [-1 if e is None else (e[0] << RANK_BITS | e[1]) << RANK_BITS | e[2] for e in table]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(*arrays: Column) -> Column:
    """The arrays' elements, by an expression that costs less a row than concat."""
    return F.flatten(F.array(*arrays))


def _literal(numbers: list[int], kind: str) -> Column:
    """An array of numbers, by way of one string: the optimizer makes it one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def merged_ids(word: Column, path: str) -> Column:
    """Ids (array of int) of a word, given as an array of its bytes (0 to 255)."""
    of_bytes, table = rank_map(path)
    none, mask, size = 2**31 - 1, (1 << RANK_BITS) - 1, len(table)

    def fold(literal: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            """The rank of a pair of ranks, none if it doesn't merge."""
            x, y = a.cast("long"), b.cast("long")

            def at(factors: tuple[int, int], otherwise: Column) -> Column:
                place = ((x * factors[0] + y * factors[1]) % size).cast("int")
                same = lambda e: F.shiftright(e, RANK_BITS) == x * (1 << RANK_BITS) + y
                return _let(F.get(literal["table"], place), lambda e: F.when(same(e), e.bitwiseAND(mask).cast("int")).otherwise(otherwise))

            return at(FIRST, at(SECOND, F.lit(none)))

        def merge(state: Column, _: Column) -> Column:
            parts, ranks = state["parts"], state["ranks"]

            def put(least: Column, i: Column) -> Column:  # i: from 1, of the pair's left part
                nothing = F.slice(ranks, 1, 0)
                before = F.when(i > 1, _joined(F.slice(ranks, F.lit(1), i - 2), F.array(rank(F.get(parts, i - 2), least)))).otherwise(nothing)
                after = F.when(i + 1 < F.size(parts), _joined(F.array(rank(least, F.get(parts, i + 1))), F.slice(ranks, i + 2, F.size(ranks)))).otherwise(nothing)
                return F.struct(
                    _joined(F.slice(parts, F.lit(1), i - 1), F.array(least), F.slice(parts, i + 2, F.size(parts))).alias("parts"),
                    _joined(before, after).alias("ranks"),
                )

            return F.when(F.coalesce(F.array_min(ranks), F.lit(none)) == none, state).otherwise(
                _let(F.array_min(ranks), lambda least: _let(F.array_position(ranks, least).cast("int"), lambda i: put(least, i)))
            )

        def folded(parts: Column) -> Column:
            pairs = F.when(F.size(parts) > 1, F.sequence(F.lit(0), F.size(parts) - 2)).otherwise(F.array().cast("array<int>"))
            start = F.struct(parts.alias("parts"), F.transform(pairs, lambda i: rank(F.get(parts, i), F.get(parts, i + 1))).alias("ranks"))
            return F.aggregate(pairs, start, merge, lambda s: s["parts"])

        return _let(F.transform(word, lambda x: F.get(literal["bytes"], x)), folded)

    return _let(F.struct(_literal(table, "bigint").alias("table"), _literal(of_bytes, "int").alias("bytes")), fold)


def windows(word: bytes) -> list[bytes]:
    """The overlapping parts in which a word is folded: itself, unless it is long."""
    return [word[i : i + WIDTH] for i in range(0, max(1, len(word) - (WIDTH - STEP)), STEP)] if len(word) > WIDTH else [word]


def stitched(folded: list[bytes], sizes) -> bytes | None:
    """A word's ids, by those of its windows and all ids' lengths; None where two windows share no token."""
    import numpy as np

    out: list = []
    last_ends = None
    for k, raw in enumerate(folded):
        ids = np.frombuffer(raw, "<u4")
        ends = np.cumsum(sizes[ids]) + k * STEP
        if k:
            # the last token that both have: the same id with the same end
            _, left, right = np.intersect1d(last_ends << 20 | out[-1], ends << 20 | ids, assume_unique=True, return_indices=True)
            if not len(left):
                return None
            i = int(np.argmax(left))
            out[-1] = out[-1][: left[i] + 1]
            ids, ends = ids[right[i] + 1 :], ends[right[i] + 1 :]
        out.append(ids)
        last_ends = ends
    return np.concatenate(out).tobytes()


def merged(word: bytes, of: dict[bytes, int]) -> bytes:
    """A word's ids: its pairs in the order of rank and place, from a heap."""
    from array import array
    from heapq import heapify, heappop, heappush

    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins there; 0: none does
    heap = [(of[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in of]
    heapify(heap)
    while heap:
        _, start, stop = heappop(heap)
        middle = end[start]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of its parts has merged with another since
        end[start], end[middle] = stop, 0
        before[stop] = start
        for a, b in ((before[start], stop), (start, end[stop] if stop < n else 0)):
            if a >= 0 and b and (rank := of.get(word[a:b])) is not None:
                heappush(heap, (rank, a, b))
    return array("I", [of[word[i : end[i]]] for i in range(n) if end[i]]).tobytes()


def _bytes_of(lists, kind: str) -> Iterator[bytes]:
    """Each list of numbers as bytes of kind."""
    import numpy as np

    for chunk in lists.chunks:
        raw = chunk.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
        ends = np.cumsum(np.asarray(chunk.value_lengths(), np.int64)) * np.dtype(kind).itemsize
        start = 0
        for end in ends.tolist():
            yield raw[start:end]
            start = end


def encode(docs: DataFrame, path: str, pattern: str, finish: Callable = pieces.ids_only, schema: str = "doc_id long, ids binary") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) for each row of docs (doc_id, text), or what finish makes of them."""
    matches = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    texts, shares = pieces.unstashed_blocks(docs, pieces.byte_level)

    def distinct_words(t):
        """The bucket's words that aren't tokens themselves."""
        import numpy as np
        import pyarrow as pa
        import regex

        words_of, tokens = regex.compile(matches).findall, _ranks(path)
        different: set[str] = set()
        for e in t["entries"]:
            different.update(pieces._unpack_texts(e.as_py()))
        raw = sorted({x for p in different for w in words_of(p) if (b := w.encode()) not in tokens for x in windows(b)})
        del different
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, raw)]).astype(np.int32), pa.array(np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)))
        return pa.table({"of": pa.array(t["bucket"].to_pylist()[:1] * len(raw), pa.int32()), "bytes": lists})

    words = shares.groupBy("bucket").applyInArrow(distinct_words, "of int, bytes array<int>")
    known = words.select("of", "bytes", merged_ids(F.col("bytes"), path).alias("ids"))

    def resolve(t, known):
        from array import array

        import numpy as np
        import pyarrow as pa
        import regex

        tokens = _ranks(path)
        sizes = np.array([len(x) for x in read_ranks(path)], np.int64)
        own = dict(zip(_bytes_of(known["bytes"], "u1"), _bytes_of(known["ids"], "<u4"), strict=True))

        def ids_of(missing: list[str]) -> Iterator:
            for w in missing:
                b = w.encode()
                if b in tokens:
                    yield array("I", [tokens[b]]).tobytes()
                elif len(b) <= WIDTH:
                    yield own[b]
                else:
                    ids = stitched([own[x] for x in windows(b)], sizes)
                    yield merged(b, tokens) if ids is None else ids

        entries = pieces._resolved(t["entries"].to_pylist(), ids_of, regex.compile(matches).findall)
        return pa.table({"entry_block": t["entry_block"], "bucket": t["bucket"], "numbers": t["numbers"], "entries": pa.array(entries, pa.binary())})

    encoded = shares.groupBy("bucket").cogroup(known.groupBy("of")).applyInArrow(resolve, pieces.ENTRIES)
    return pieces.put_together(texts, encoded, finish, schema)


def decoded(ids: list[bytes], path: str) -> Iterator[bytes]:
    """The vocabulary's pieces for each of the ids, put together."""
    import numpy as np

    tokens = read_ranks(path)
    sizes = np.array([len(t) for t in tokens], np.int64)
    starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(tokens), np.uint8)
    for x in ids:
        yield pieces.gathered(np.frombuffer(x, "<u4"), starts, sizes, flat)[0].tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with decoded: the bytes its ids stand for."""

    def put_together(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = list(decoded(batch.column("ids").to_pylist(), path))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(put_together, "doc_id long, ids binary, decoded binary")


def encoding_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs: digests of encode()'s ids and of what they decode to."""

    def digest(doc_ids: list, ids: list[bytes]):
        from hashlib import sha256

        import pyarrow as pa

        return pa.table({
            "doc_id": pa.array(doc_ids, pa.int64()),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([sha256(x).hexdigest() for x in decoded(ids, path)], pa.string()),
        })

    return encode(docs, path, pattern, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """rank, token: the vocabulary as a table."""
    return spark.createDataFrame(list(enumerate(read_ranks(path))), "rank int, token binary")
