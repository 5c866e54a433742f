"""Operator 2, MinHash near-dedup: DartMinHash signatures and a banded join.

A text's elements are its distinct shingles of SHINGLE words (all words, if there are
fewer), each of weight 1, or as often as it occurs. Over each element lies a plane of weight
and rank, in cells; a hash of element and cell throws a Poisson number of darts into it, each
at a hashed place and with a hashed coordinate. A text sees the darts below its elements'
weights, and its signature keeps the earliest (lowest rank) for each coordinate. Two
signatures agree in a coordinate with the probability of the weighted Jaccard similarity of
the texts. Ranks are looked at cell by cell, up to about k ln k + 2 k darts of a text, and on
for texts that have a coordinate without a dart; so the work is little more than a dart or
so an element, whatever k is.

Texts with equal elements are put together first. Coordinates are joined in BANDS bands of
ROWS: at a similarity of 0.8 two texts share no band with a probability of 0.00006. Texts of
a band are compared, by their sets of shingles, with the first and the last of it, not all
with all. Where a band's texts are in several classes after that, those of different classes
are compared: all of them in bands of up to SMALL texts, with CENTERS more in larger ones.
Larger bands that still hold several classes go to an exact join: a pair of THRESHOLD or more
has the rarest shingle it shares among the first ones of both (prefix, length and position
filters), so every such pair of different classes is compared.

Classes are the connected components of links of THRESHOLD or more, by the alternation of
large and small stars.

Defined cases: null texts and those without a word are in no link, each a class of its own; a
text of any length is taken whole, one such at a time; a similarity of THRESHOLD itself is a
link; repeated rows are of one class, and of equal doc_ids the first row counts as first; a null doc_id is carried; an empty table gives no rows;
further columns are carried by deduplicate(), else not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import scratch, stash

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
SMALL, CENTERS = 32, 3
#: Slots in which shingles' holders are counted (they only set the order from rare to common),
#: and holders of a shingle that one task pairs with all others.
SLOTS, HOT = 1 << 20, 2000
#: Texts of a band up to which its rows meet in one task, and larger bands (a row of some 60
#: bytes each) that may go to every task.
HOT_BAND, BROADCAST_BANDS = 500, 100_000

#: Bounds of the first cells of rank; each further one is 1 wide.
_FIRST_CELLS = (0.0, 0.25, 0.5, 1.0)
#: Texts whose signatures are made at once.
_TEXTS_AT_ONCE = 128


def elements(words, shingle: int, counted: bool):
    """Of each text of words: its distinct shingles (sorted by text), their weights, and the text of each."""
    import numpy as np

    from millrace.llm.words import mix

    hashes, whole = words.windows(shingle)
    at = np.flatnonzero(whole)
    docs = words.doc_of_word()
    sizes = np.diff(words.bounds)
    keys, of = [hashes[at]], [docs[at]]
    for i in np.flatnonzero((sizes > 0) & (sizes < shingle)):
        own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        h = np.uint64(len(own))
        for x in own:
            h = mix(np.array([h], np.uint64) ^ x)[0]
        keys.append(np.array([h], np.uint64))
        of.append(np.array([i]))
    keys, of = np.concatenate(keys), np.concatenate(of)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate([first, [len(keys)]]))
    return keys[first], counts.astype(float) if counted else np.ones(len(first)), of[first]


@lru_cache
def _poisson_bounds(mean: float):
    """Of a uniform 64-bit number: there are as many darts as bounds it reaches."""
    import math

    import numpy as np

    bounds, p, total = [], math.exp(-mean), 0.0
    for i in range(40):
        total += p
        if total >= 1 - 2.0**-52:
            break
        bounds.append(min(int(total * 2**64), 2**64 - 1))
        p *= mean / (i + 1)
    return np.array(bounds, np.uint64)


def _throw(flat, k: int, bases, limits, texts, cells, lower, width: float) -> None:
    """Throws the darts of pairs of (element with a cell of weight) and cell of rank; flat keeps the earliest.

    bases, limits, texts: of each pair's element; cells: the pair's cell of rank, from lower, width wide.
    """
    import numpy as np

    from millrace.llm.words import mix

    h = mix(bases ^ ((cells + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)))
    at = np.arange(len(h))
    number = 0
    for bound in _poisson_bounds(width):  # pairs with one dart or more, with two or more, and so on
        at = at[h[at] >= bound]
        if not len(at):
            break
        number += 1
        a = mix(h[at] + np.uint64(number * 0xD6E8FEB86659FD93 & (2**64 - 1)))
        seen = at
        partial = limits[at] < 1.0
        if partial.any():
            b = mix(a ^ np.uint64(0x2545F4914F6CDD1D))
            keep = (b >> np.uint64(11)).astype(float) * 2.0**-53 < limits[at]
            a, seen = a[keep], at[keep]
        # the bits of positive single-precision numbers are in the order of the numbers
        rank = (lower[seen] + (a >> np.uint64(32)).astype(float) * (2.0**-32 * width)).astype(np.float32).view(np.uint32).astype(np.uint64)
        c = mix(a + np.uint64(0x632BE59BD9B4E019))
        place = texts[seen] * k + ((c >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, place, rank << np.uint64(32) | (c & np.uint64(0xFFFFFFFF)))


def signatures(keys, weights, of, n_texts: int, k: int):
    """(n_texts, k) array of the earliest darts; rows of texts without elements are all ones.

    keys, weights and of (the text) are those of the elements, sorted by text.
    """
    import numpy as np

    out = np.full((n_texts, k), 2**64 - 1, np.uint64)
    bounds = np.searchsorted(of, np.arange(0, n_texts + _TEXTS_AT_ONCE, _TEXTS_AT_ONCE))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        first = i * _TEXTS_AT_ONCE
        if a < b:
            _sign(out[first : first + _TEXTS_AT_ONCE], keys[a:b], weights[a:b], of[a:b] - first, k)
    return out


def _sign(out, keys, weights, of, k: int) -> None:
    import numpy as np

    from millrace.llm.words import mix

    n_texts, flat = len(out), out.reshape(-1)
    # an element of weight w has cells [0, 1), [1, 2) and so on of weight
    cells = np.ceil(weights).astype(np.int64)
    rep = np.repeat(np.arange(len(keys)), cells)
    low = np.arange(len(rep)) - np.repeat(np.cumsum(cells) - cells, cells)
    bases = mix(keys[rep] + low.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    limits, texts = weights[rep] - low, of[rep]
    total = np.bincount(of, weights, n_texts)
    wanted = k * np.log(k) + 2 * k
    upto = np.where(total > 0, wanted / np.maximum(total, 1e-300), 0.0)
    for cell in range(len(_FIRST_CELLS) - 1):
        lower, upper = _FIRST_CELLS[cell : cell + 2]
        mine = np.flatnonzero(upto[texts] > lower)
        _throw(flat, k, bases[mine], limits[mine], texts[mine], np.full(len(mine), cell, np.uint64), np.full(len(mine), lower), upper - lower)
    # then all cells 1 wide that a text needs, and some more while it lacks a coordinate
    done = np.ones(n_texts, np.int64)
    need = np.where(upto > 1, np.ceil(upto), 1).astype(np.int64)
    full = np.uint64(2**64 - 1)
    while True:
        times = (need - done)[texts]
        pairs = np.repeat(np.arange(len(texts)), times)
        if len(pairs):
            cell = done[texts[pairs]] + np.arange(len(pairs)) - np.repeat(np.cumsum(times) - times, times)
            _throw(flat, k, bases[pairs], limits[pairs], texts[pairs], cell.astype(np.uint64) + np.uint64(len(_FIRST_CELLS)), cell.astype(float), 1.0)
        lacking = (total > 0) & (out == full).any(axis=1)
        if not lacking.any():
            return
        # cells between a text's own bound and 1 come first: they are below the cells 1 wide
        for cell in range(len(_FIRST_CELLS) - 1):
            lower, upper = _FIRST_CELLS[cell : cell + 2]
            mine = np.flatnonzero((lacking & (upto <= lower))[texts])
            _throw(flat, k, bases[mine], limits[mine], texts[mine], np.full(len(mine), cell, np.uint64), np.full(len(mine), lower), upper - lower)
        done = need
        need = np.where(lacking, need + 1 + need // 4, need)


def band_keys(signature, bands: int, rows: int):
    """(n_texts, bands) array of hashes of the signatures' bands."""
    import numpy as np

    from millrace.llm.words import mix

    parts = signature.reshape(len(signature), bands, rows)
    out = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(signature), axis=0)
    for j in range(rows):
        out = mix(out ^ parts[:, :, j]) + np.uint64(j)
    return out


def sketches(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """row, doc_id, content (hash of the elements, null without any), n, bands, shingles (sorted 32-bit hashes) for each row."""

    def sketch(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from millrace.llm.words import Words, chunks

        n_rows = 0
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            content, n, keys_of, shingles = [], [], [], []
            for _, part in chunks(raw, 1 << 18):
                keys, weights, of = elements(Words(part), shingle, counted)
                bounds = np.searchsorted(of, np.arange(len(part) + 1))
                keys_of.append(band_keys(signatures(keys, weights, of, len(part), bands * rows), bands, rows))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n.append(b - a)
                    content.append(xxhash.xxh3_128_digest(keys[a:b].tobytes() + weights[a:b].tobytes() * counted) if b > a else None)
                    shingles.append(np.unique(keys[a:b].astype(np.uint32)).tobytes())
            found = np.concatenate(keys_of).astype(np.int64) if keys_of else np.zeros((0, bands), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * bands), pa.array(found.ravel()))
            first = (batch.column(2)[0].as_py() << 33) + n_rows if len(raw) else 0
            n_rows += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(raw), dtype=np.int64)), batch.column(0), pa.array(content, pa.binary()), pa.array(n, pa.int32()), lists, pa.array(shingles, pa.binary())], ["row", "doc_id", "content", "n", "bands", "shingles"])
            pa.default_memory_pool().release_unused()  # the worker stays, and its memory counts

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().cast("long"))
    return plain.mapInArrow(sketch, "row long, doc_id long, content binary, n int, bands array<long>, shingles binary")


def _similar(pairs: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of rows whose shingles' similarity is threshold or more."""
    sets = sketched.select("row", "shingles")
    joined = pairs.join(sets.withColumnsRenamed({"row": "a", "shingles": "of_a"}), "a").join(sets.withColumnsRenamed({"row": "b", "shingles": "of_b"}), "b")

    def verify(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= threshold * (len(both) - common) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return joined.mapInArrow(verify, "a long, b long")


def _sharing(rows: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of rows (row, class) of different classes; all pairs of threshold or more are among them.

    With each text's shingles from rare to common, the first that two texts share is at places
    i and j, and they share at most what is left of either from there on. Any order that is the
    same for all texts gives right results; the counts make few texts meet.
    """
    sets = stash(rows.join(sketched.select("row", "shingles"), "row"), "open-texts")

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(n, np.frombuffer(x, "<u4") % SLOTS, 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["slot", "n"])

    import numpy as np

    counted = sets.select("shingles").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator) -> Iterator:
        import math

        import numpy as np
        import pyarrow as pa

        n = shared.value
        for batch in batches:
            found, sizes, lengths = [np.zeros(0, np.uint32)], [], []
            for x in batch.column("shingles").to_pylist():
                x = np.frombuffer(x, "<u4")
                found.append(x[np.lexsort((x, n[x % SLOTS]))][: len(x) - math.ceil(threshold * len(x) - 1e-6) + 1])
                sizes.append(len(x))
                lengths.append(len(found[-1]))
            of = np.repeat(np.arange(len(sizes)), lengths)
            place = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            take = pa.array(of)
            columns = [pa.array(np.concatenate(found).view(np.int32)), batch.column("row").take(take), batch.column("class").take(take)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(sizes, np.int32)[of]), pa.array(place.astype(np.int32))], ["shingle", "row", "class", "n", "at"])

    first = stash(sets.mapInArrow(prefixes, "shingle int, row long, class long, n int, at int"), "prefixes")
    held = first.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("class").alias("c1"), F.max("class").alias("c2")).where("c1 != c2")
    met = first.join(held.select("shingle", F.ceil(F.col("holders") / HOT).cast("int").alias("salts")), "shingle")
    one = met.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    all_of = met.select("shingle", F.col("row").alias("row2"), F.col("class").alias("class2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    least = (F.col("n") + F.col("n2")) * (threshold / (1 + threshold)) - 1e-6
    near = (F.col("class") < F.col("class2")) & (F.col("n") - F.col("at") >= least) & (F.col("n2") - F.col("at2") >= least)
    near &= (F.col("n") >= threshold * F.col("n2") - 1e-6) & (F.col("n2") >= threshold * F.col("n") - 1e-6)
    return one.join(all_of, ["shingle", "salt"]).where(near).select(F.greatest("row", "row2").alias("a"), F.least("row", "row2").alias("b")).distinct()


def _of_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """rows joined with bands (a row for each band, with its size). Rows of bands of more than HOT_BAND texts stay where they are."""
    hot = bands.where(F.col("size") > HOT_BAND)
    if hot.count() > BROADCAST_BANDS:
        return rows.join(bands, "band")
    others = rows.join(F.broadcast(hot.select("band")), "band", "left_anti").join(bands.where(F.col("size") <= HOT_BAND), "band")
    return rows.join(F.broadcast(hot), "band").unionByName(others)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, class (its component's least node) for the nodes of links (a, b)."""
    links = stash(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).where("a != b").distinct()
        links = stash(small, "links")
        before, state = state, links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())
    raise RuntimeError("components didn't settle")


def classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """row, doc_id, class_id for each row of docs (doc_id, text); equal class_id: near duplicates."""
    sketched = stash(sketches(docs, shingle, bands, rows, counted), "sketches")
    texts = sketched.where("content is not null")
    # one row for each set of elements
    firsts = stash(texts.groupBy("content").agg(F.min("row").alias("first"), F.min_by("n", "row").alias("n"), F.min_by("bands", "row").alias("bands")), "contents")
    banded = firsts.select(F.col("first").alias("row"), "n", F.explode("bands").alias("band"))
    ends = stash(banded.groupBy("band").agg(F.count("*").alias("size"), F.min("row").alias("low"), F.max("row").alias("high")).where("size > 1"), "band-ends")
    met = stash(_of_bands(banded, ends), "bands")
    links = stash(_similar(met.select(F.explode(F.array(F.struct(F.col("row").alias("a"), F.col("low").alias("b")), F.struct(F.col("row").alias("a"), F.col("high").alias("b")))).alias("p")).select("p.*").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), texts, threshold), "similar")
    found = stash(components(links), "classes")

    # bands of up to three texts are compared wholly by now
    many = met.where("size > 3").join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("class", F.coalesce("class", "row"))
    mixed = many.groupBy("band").agg(F.first("size").alias("size"), F.min("class").alias("c1"), F.max("class").alias("c2"), *(F.min_by("row", F.xxhash64("row", F.lit(i))).alias(f"center{i}") for i in range(CENTERS))).where("c1 != c2").drop("c1", "c2")
    mixed = stash(_of_bands(many.drop("size"), stash(mixed, "mixed")), "mixed-bands")
    if not mixed.isEmpty():
        small = mixed.where(F.col("size") <= SMALL).select("band", "row", "n", "class")
        other = small.withColumnsRenamed({"row": "row2", "n": "n2", "class": "class2"})
        near = (F.col("n") >= threshold * F.col("n2")) & (F.col("n2") >= threshold * F.col("n"))
        near = near if not counted else F.lit(True)
        pairs = small.join(other, "band").where((F.col("class") < F.col("class2")) & near).select(F.col("row").alias("a"), F.col("row2").alias("b"))
        centers = mixed.where(F.col("size") > SMALL).select(F.col("row").alias("a"), F.explode(F.array(*(f"center{i}" for i in range(CENTERS)))).alias("b")).where("a != b")
        pairs = pairs.unionByName(centers).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        more = stash(_similar(pairs, texts, threshold), "more-similar")
        if not more.isEmpty():
            found = stash(components(found.select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(more)), "classes")

        large = mixed.where(F.col("size") > SMALL).select("band", "row").join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("class", F.coalesce("class", "row"))
        several = large.groupBy("band").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).where("c1 != c2")
        rest = stash(large.join(several, "band", "left_semi").select("row", "class").distinct(), "open")
        if not rest.isEmpty():
            more = stash(_similar(_sharing(rest, texts, threshold), texts, threshold), "last-similar")
            if not more.isEmpty():
                found = stash(components(found.select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(more)), "classes")

    of_content = firsts.select("content", "first").join(found.withColumnRenamed("node", "first"), "first", "left").select("content", F.coalesce("class", "first").alias("of_content"))
    return sketched.select("row", "doc_id", "content").join(of_content, "content", "left").select("row", "doc_id", F.coalesce("of_content", "row").alias("class_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, first (of its class: that of the least doc_id) for each row of docs."""
    with scratch(docs.sparkSession):
        found = stash(classes(docs, **options), "near-duplicates", outlives=True)
    # joined by row, not by class, of which one may have a third of all rows
    firsts = found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("f")).select(F.col("f.row").alias("first_row"))
    return found.join(firsts, F.col("row") == F.col("first_row"), "left").select("doc_id", "class_id", F.col("first_row").isNotNull().alias("first"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: that of the least doc_id.

    docs must give the same rows in the same order each time, as a scan of files does: rows
    are known by their place in it. The job fails if a kept row's id or text differs between two
    readings.
    """
    numbered = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns))).withColumn("in_row", F.monotonically_increasing_id())
    text, ident = (F.col(f"in_{docs.columns.index(c)}") for c in ("text", "doc_id"))
    found = near_duplicates(numbered.select(F.col("in_row").alias("doc_id"), text.alias("text")), **options)
    mark = F.xxhash64(ident, text)
    placed = numbered.select("in_row", ident.alias("ident"), mark.alias("mark")).join(found.select(F.col("doc_id").alias("of"), "class_id"), F.col("in_row") == F.col("of"))
    # the first of a class by doc_id, not by row
    best = placed.groupBy("class_id").agg(F.min(F.struct(F.col("ident").isNull().alias("x"), F.col("ident").alias("i"), F.col("in_row").alias("r"), F.col("mark").alias("m"))).alias("b")).select(F.col("b.r").alias("kept_row"), F.col("b.m").alias("kept_mark"))
    kept = numbered.join(best, F.col("in_row") == F.col("kept_row"))
    same = F.when(mark != F.col("kept_mark"), F.raise_error(F.lit("the rows differ between two readings")).cast("boolean")).otherwise(F.lit(True))
    return kept.where(same).select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))
