"""Operator 4, suffix-array dedup: sparse suffix arrays over words.

A passage repeats if a window of MIN_WORDS words is found again, in the same text or another.

Suffixes are retained only at minimiser positions: a window's minimiser is the first place in
it where the hash of the next SEED words is least, so equal windows have theirs at the same
place and both ends of every repeat retain a suffix with the same SEED words.

1. Hashes of the suffixes' first SEED words are sorted, in ranges, and neighbours compared;
   suffixes whose seed is found once go.
2. The others are sorted as suffixes, word by word, and each is compared with its two
   neighbours: the longer common prefix is how far it matches any other to the right. Sorted by
   the words before it, read backwards, its neighbours tell the same of the left.
   Words stand there for 16 bits of their hashes: a reach may come out too long, never short.
3. Matches are extended: of the windows with that minimiser, those that begin no farther left
   and end no farther right may repeat. One suffix may match on the left and another on the
   right, so windows are compared themselves in the last step, by a hash of their MIN_WORDS
   words, and a window is found to repeat exactly if its words do. Windows that overlap make a
   span.

Texts lie in blocks of bounded size. A block sorts its own suffixes and windows first and
passes on each different one once, so one that is in all texts is one entry of each block. A
seed that is found more than HOT times in all (a phrase that many texts have) skips step 2, in
which its suffixes would meet in one task; its windows go to the last step, all of them.

Of a window's occurrences the first (by block and place) stays; all others are cut.

Defined cases: null and empty texts, and texts of fewer than MIN_WORDS words, have no
spans; a text of any length is worked on whole, some words at a time; rows that repeat are
repeats of each other; ties between a window's places go to the first; a null doc_id is
carried; an empty table gives no rows; further columns are carried where texts are cut, else
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash

MIN_WORDS, SEED = 50, 8
BLOCK_BYTES = 16 << 20
#: Bytes of text for each range of hashes that is sorted by one task.
RANGE_BYTES = 16 << 20
#: Occurrences of a seed up to which its suffixes are sorted by one task.
HOT = 20_000
#: Suffixes whose words are laid out at once.
AT_ONCE = 1 << 14

ENTRIES = "entry_block long, entry_range int, hashes binary, flags binary"
SUFFIXES = "suffix_block long, suffix_range int, keys binary, seeds binary, words binary, often binary"
REACHES = "suffix_block long, keys binary, right binary, left binary"
SPANS = "block long, number long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, cuts array<struct<start:long,end:long>>"


def _minimisers(seeds, width: int):
    """The (first) place of the least of the next width seeds, from each place on (shorter by width - 1)."""
    import numpy as np

    at, have = np.arange(len(seeds)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: max(0, len(at) - step)], at[step:]
        at = np.where(seeds[b] < seeds[a], b, a)
        have += step
    return at


def _windows(words, min_words: int, seed: int):
    """Starts of the windows of min_words words in a text, the place of each one's minimiser, and the seeds at all places."""
    import numpy as np

    seeds = words.spans(seed)
    at = _minimisers(seeds, min_words - seed + 1)
    ends = np.repeat(words.bounds[1:], np.diff(words.bounds))
    starts = np.flatnonzero(np.arange(len(at)) + min_words <= ends[: len(at)])
    return starts, at[starts], seeds


def _contexts(words, places, min_words: int, seed: int):
    """(words, keys): for each place the words of all windows that may have it as minimiser (16 bits of hash each, 0 outside of the text), and a hash of them."""
    import numpy as np

    from millrace.llm.words import mix

    short = (words.hashes >> np.uint64(48)).astype(np.uint16)
    text_of = np.searchsorted(words.bounds, places, side="right") - 1
    at = places[:, None] + np.arange(seed - min_words, min_words)
    inside = (at >= words.bounds[text_of][:, None]) & (at < words.bounds[text_of + 1][:, None])
    out = np.where(inside, short[np.clip(at, 0, max(0, len(short) - 1))], np.uint16(0))
    spread = mix(np.arange(1, out.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    return out, mix((out.astype(np.uint64) * spread).sum(1, dtype=np.uint64))


def _ranged(block: int, hashes, flags, bits: int):
    """A record batch of ENTRIES: sorted hashes cut into 2**bits ranges."""
    import numpy as np
    import pyarrow as pa

    cuts = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], cuts, [len(hashes)]]).tolist()
    some = [i for i in range(1 << bits) if bounds[i] < bounds[i + 1]]
    cut = lambda x, kind: pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in some], kind)
    return pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), cut(hashes, pa.binary()), cut(flags, pa.binary())], ["entry_block", "entry_range", "hashes", "flags"])


def _compared(entries: DataFrame, only_repeated: bool) -> DataFrame:
    """ENTRIES of blocks, sorted together by range and compared with their neighbours.

    flags come as the times that a block has the hash (32 bits), and go as a byte each, 0:
    found nowhere else, 1: repeated, first found in this block, 2: repeated, first found in an
    earlier one; of those that repeat alone, 1, and 3 where there are more than HOT in all.
    """
    hot = HOT

    def compare(t):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(t["entry_block"].to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        parts = [np.frombuffer(x, "<u8") for x in t["hashes"].to_pylist()]
        hashes = np.concatenate(parts)
        times = np.concatenate([np.frombuffer(x, "<u4") for x in t["flags"].to_pylist()]).astype(np.int64)
        place = np.argsort(hashes, kind="stable")
        ranked = hashes[place]
        later = np.concatenate([[False], ranked[1:] == ranked[:-1]])[: len(ranked)]
        group = np.cumsum(~later) - 1
        total = np.bincount(group, times[place], minlength=1)[group]
        flags = np.zeros(len(hashes), np.uint8)
        flags[place] = np.where(total > 1, np.where(total > hot, 3, 1), 0) if only_repeated else np.where(later, 2, np.where(total > 1, 1, 0))
        ends = np.cumsum([len(p) for p in parts])
        out_hashes, out_flags = [], []
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            h, f = hashes[a:b], flags[a:b]
            out_hashes.append(h[f > 0].tobytes() if only_repeated else b"")
            out_flags.append((f[f > 0] if only_repeated else f).tobytes())
        return pa.table({"entry_block": t["entry_block"], "entry_range": t["entry_range"], "hashes": pa.array(out_hashes, pa.binary()), "flags": pa.array(out_flags, pa.binary())})

    return entries.groupBy("entry_range").applyInArrow(compare, ENTRIES)


def _runs(starts, ends):
    """Overlapping or touching [start, end) put together; sorted by start."""
    import numpy as np

    if not len(starts):
        return []
    upto = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > upto[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts[first], upto[last], strict=True)]


def _blocks(docs: DataFrame, min_words: int, seed: int, bits: int, carry: list[str]) -> DataFrame:
    """Rows of texts (block, number, doc_id, text, carried columns), and each block's retained suffixes (ENTRIES)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("in_id"), F.col("text").cast("string").alias("in_text"), *(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(carry)), F.spark_partition_id().cast("long").alias("in_part"))
    kept = plain.drop("in_part")
    schema = f"block long, number long, {', '.join(f'`{n}` {t}' for n, t in kept.dtypes)}, {ENTRIES}"

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from millrace.llm.words import Words, chunks

        kinds = None
        n_blocks, number, size, part, held = 0, 0, 0, 0, []

        def seeds_of(texts: list[bytes]) -> None:
            for _, some in chunks(texts):
                w = Words(some)
                _, places, seeds = _windows(w, min_words, seed)
                held.append(seeds[np.unique(places)])

        def entries(block: int):
            found, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            e = _ranged(block, found, counts.astype("<u4"), bits)
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(e), f.type) for f in kinds), *e.columns], [*(f.name for f in kinds), *e.schema.names])

        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(batch.num_columns - 1)[0].as_py()
            own = batch.drop_columns(["in_part"])
            kinds = [pa.field("block", pa.int64()), pa.field("number", pa.int64()), *own.schema]
            raw = [(t or "").encode() for t in own.column(1).to_pylist()]
            first, taken = 0, []
            for i, t in enumerate(raw):
                taken.append(t)
                size += len(t)
                if size >= BLOCK_BYTES or i + 1 == len(raw):
                    rows = own.slice(first, i + 1 - first)
                    block = (part << 24) + n_blocks
                    nothing = [pa.nulls(len(rows), k) for k in (pa.int64(), pa.int32(), pa.binary(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(range(number, number + len(rows)), pa.int64()), *rows.columns, *nothing], [*(f.name for f in kinds), "entry_block", "entry_range", "hashes", "flags"])
                    seeds_of(taken)
                    number += len(rows)
                    first, taken = i + 1, []
                    if size >= BLOCK_BYTES:
                        yield entries(block)
                        n_blocks, number, size = n_blocks + 1, 0, 0
        if size or number:
            yield entries((part << 24) + n_blocks)

    return stash(plain.mapInArrow(cut, schema), "repeat-blocks")


def _suffixes(texts: DataFrame, found: DataFrame, min_words: int, seed: int, bits: int) -> DataFrame:
    """SUFFIXES of blocks: each different one with a repeated seed, but for hot ones, with the words around it, in ranges of seeds."""

    def lay_out(t, seeds_in):
        import numpy as np
        import pyarrow as pa

        from millrace.llm.words import Words, chunks

        names = [c.split()[0] for c in SUFFIXES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        empty = pa.table([pa.array([], k) for k in kinds], names=names)
        if not t.num_rows or not seeds_in.num_rows:
            return empty
        block = t["block"][0].as_py()
        flags = np.frombuffer(b"".join(seeds_in["flags"].to_pylist()), np.uint8)
        wanted = np.sort(np.frombuffer(b"".join(seeds_in["hashes"].to_pylist()), "<u8")[flags == 1])
        if not len(wanted):
            return empty
        keys, seeds, rows = [], [], []
        for _, some in chunks([(x or "").encode() for x in t["in_text"].to_pylist()]):
            w = Words(some)
            _, places, own = _windows(w, min_words, seed)
            places = np.unique(places)
            places = places[_among(wanted, own[places])]
            for i in range(0, len(places), AT_ONCE):
                part = places[i : i + AT_ONCE]
                around, key = _contexts(w, part, min_words, seed)
                keys.append(key)
                seeds.append(own[part])
                rows.append(around)
        if not keys:
            return empty
        keys, at, counts = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        seeds, rows = np.concatenate(seeds)[at], np.concatenate(rows)[at]
        order = np.argsort(seeds, kind="stable")
        cuts = np.searchsorted(seeds[order], np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        parts = [(i, p) for i, p in enumerate(np.split(order, cuts)) if len(p)]
        put = lambda x: pa.array([x[p].tobytes() for _, p in parts], pa.binary())
        return pa.table([pa.array([block] * len(parts), pa.int64()), pa.array([i for i, _ in parts], pa.int32()), put(keys), put(seeds), put(rows), put((counts > 1).astype(np.uint8))], names=names)

    return texts.groupBy("block").cogroup(found.groupBy("entry_block")).applyInArrow(lay_out, SUFFIXES)


def _among(wanted, values):
    """Which of values are in wanted (sorted, not empty)."""
    import numpy as np

    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _reach(seeds, words):
    """For each suffix, the most words it has in common, from the first on, with another of its seed: with one of its neighbours in the order of suffixes."""
    import numpy as np

    n, width = words.shape
    written = np.concatenate([seeds.astype(">u8").view(np.uint8).reshape(n, 8), np.ascontiguousarray(words, ">u2").view(np.uint8).reshape(n, 2 * width)], axis=1)
    order = np.argsort(np.ascontiguousarray(written).view(f"S{8 + 2 * width}").ravel(), kind="stable")
    a, b = order[:-1], order[1:]
    differ = words[a] != words[b]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common[seeds[a] != seeds[b]] = 0
    out = np.zeros(n, np.int64)
    out[a] = common
    out[b] = np.maximum(out[b], common)
    return out


def _reaches(suffixes: DataFrame, min_words: int, seed: int) -> DataFrame:
    """REACHES: of each block's suffixes, the words that match another to the right (from its first on) and to the left."""

    def sort(t):
        import numpy as np
        import pyarrow as pa

        before = min_words - seed
        seeds = np.frombuffer(b"".join(t["seeds"].to_pylist()), "<u8")
        words = np.frombuffer(b"".join(t["words"].to_pylist()), "<u2").reshape(len(seeds), before + min_words)
        often = np.frombuffer(b"".join(t["often"].to_pylist()), np.uint8).astype(bool)
        right = np.where(often, min_words, _reach(seeds, words[:, before:])).astype(np.uint8)
        left = np.where(often, before, _reach(seeds, words[:, :before][:, ::-1]) if before else 0).astype(np.uint8)
        ends = np.cumsum([len(x) // 8 for x in t["keys"].to_pylist()]).tolist()
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())
        return pa.table([t["suffix_block"], t["keys"], cut(right), cut(left)], names=["suffix_block", "keys", "right", "left"])

    return suffixes.groupBy("suffix_range").applyInArrow(sort, REACHES)


def _extended(texts: DataFrame, found: DataFrame, reaches: DataFrame, min_words: int, seed: int, bits: int) -> DataFrame:
    """Windows as far as the suffixes reach: a block's ENTRIES, and for each text with some, their places and numbers in the block's order."""

    def extend(t, suffixes):
        import numpy as np
        import pyarrow as pa

        from millrace.llm.words import Words, chunks

        names = ["block", "number", "doc_id", "n_words", "starts", "places", "entry_block", "entry_range", "hashes", "flags"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        empty = pa.table([pa.array([], k) for k in kinds], names=names)
        if not t.num_rows or not suffixes.num_rows:
            return empty
        block = t["block"][0].as_py()
        t = t.take(pa.array(np.argsort(t["number"].to_numpy(), kind="stable")))
        joined = lambda c, kind: np.frombuffer(b"".join(x or b"" for x in suffixes[c].to_pylist()), kind)
        hot = np.sort(joined("hashes", "<u8")[joined("flags", np.uint8) == 3])
        keys, right, left = joined("keys", "<u8"), joined("right", np.uint8), joined("left", np.uint8)
        order = np.argsort(keys)
        keys, right, left = keys[order], right[order].astype(np.int64), left[order].astype(np.int64)
        if not len(hot) and not len(keys):
            return empty

        def reach(w, places, seeds):
            """The farthest start before each place and end after it of windows that may repeat; none: (0, 0)."""
            back, ahead = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
            for i in range(0, len(places), AT_ONCE) if len(keys) else ():
                own = _contexts(w, places[i : i + AT_ONCE], min_words, seed)[1]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                known = keys[at] == own
                back[i : i + AT_ONCE], ahead[i : i + AT_ONCE] = np.where(known, left[at], 0), np.where(known, right[at], 0)
            if len(hot):
                everywhere = _among(hot, seeds)
                back[everywhere], ahead[everywhere] = min_words, min_words
            return back, ahead

        rows, hashes, n_words = [], [], []
        raw = [(x or "").encode() for x in t["in_text"].to_pylist()]
        for first, some in chunks(raw):
            w = Words(some)
            starts, of, seeds = _windows(w, min_words, seed)
            places, at = np.unique(of, return_inverse=True)
            back, ahead = reach(w, places, seeds[places])
            lead = of - starts  # words of a window before its minimiser
            starts = starts[(lead <= back[at]) & (min_words - lead <= ahead[at])]
            if not len(starts):
                continue
            hashes.append(w.spans(min_words)[starts])
            text_of = np.searchsorted(w.bounds, starts, side="right") - 1
            cuts = np.flatnonzero(np.diff(text_of)) + 1
            for own in np.split(starts, cuts):
                i = int(np.searchsorted(w.bounds, own[0], side="right") - 1)
                rows.append((first + i, own - w.bounds[i]))
                n_words.append(int(w.bounds[i + 1] - w.bounds[i]))
        if not rows:
            return empty
        distinct, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        e = _ranged(block, distinct, counts.astype("<u4"), bits)
        places = np.split(inverse.astype("<u4"), np.cumsum([len(s) for _, s in rows])[:-1])
        picked = t.take(pa.array([i for i, _ in rows]))
        left = [pa.array([block] * len(rows), pa.int64()), picked["number"], picked["in_id"], pa.array(n_words, pa.int64()), pa.array([s.astype("<u4").tobytes() for _, s in rows], pa.binary()), pa.array([p.tobytes() for p in places], pa.binary())]
        whole = pa.table(left + [pa.nulls(len(rows), k) for k in kinds[6:]], names=names)
        rest = pa.table([pa.nulls(len(e), k) for k in kinds[:6]] + e.columns, names=names)
        return pa.concat_tables([whole, rest])

    schema = f"block long, number long, doc_id long, n_words long, starts binary, places binary, {ENTRIES}"
    # a block's hot seeds, and the reaches of its other suffixes
    seeds = found.select(F.col("entry_block").alias("of"), "hashes", "flags", *(F.lit(None).cast("binary").alias(c) for c in ("keys", "right", "left")))
    known = reaches.select(F.col("suffix_block").alias("of"), *(F.lit(None).cast("binary").alias(c) for c in ("hashes", "flags")), "keys", "right", "left")
    return texts.groupBy("block").cogroup(seeds.unionByName(known).groupBy("of")).applyInArrow(extend, schema)


def _spans(texts: DataFrame, entries: DataFrame, min_words: int) -> DataFrame:
    """SPANS of texts (block, number, doc_id, starts, places), by the flags of their blocks' windows."""

    def put_together(t, e):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        if not t.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "number": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "spans": pa.array([], kind), "cuts": pa.array([], kind)})
        t = t.take(pa.array(np.argsort(t["number"].to_numpy(), kind="stable")))
        e = e.take(pa.array(np.argsort(e["entry_range"].to_numpy(), kind="stable")))
        flags = np.frombuffer(b"".join(e["flags"].to_pylist()), np.uint8)
        seen = np.zeros(len(flags), bool)
        picked, spans, cuts = [], [], []
        for i, (starts, places) in enumerate(zip(t["starts"].to_pylist(), t["places"].to_pylist(), strict=True)):
            starts, places = np.frombuffer(starts, "<u4").astype(np.int64), np.frombuffer(places, "<u4")
            flag = flags[places]
            first = np.zeros(len(places), bool)
            first[np.unique(places, return_index=True)[1]] = True
            first &= ~seen[places]
            seen[places] = True
            repeated = flag > 0
            if repeated.any():
                go = (flag == 2) | (repeated & ~first)
                picked.append(i)
                spans.append(_runs(starts[repeated], starts[repeated] + min_words))
                cuts.append(_runs(starts[go], starts[go] + min_words))
        t = t.take(pa.array(picked, pa.int64()))
        return pa.table({"block": t["of"], "number": t["number"], "doc_id": t["doc_id"], "n_words": t["n_words"], "spans": pa.array(spans, kind), "cuts": pa.array(cuts, kind)})

    return texts.groupBy("of").cogroup(entries.groupBy("entry_block")).applyInArrow(put_together, SPANS)


def _found(docs: DataFrame, min_words: int, seed: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The stashed blocks of docs, and their SPANS."""
    if not 1 <= seed <= min_words:
        raise ValueError("1 <= seed <= min_words")
    if min_words > 255:
        raise ValueError("windows have 255 words at most")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(4, (size // RANGE_BYTES).bit_length())
    blocks = _blocks(docs, min_words, seed, bits, carry)
    seeds = stash(_compared(blocks.where("entry_block is not null").select("entry_block", "entry_range", "hashes", "flags"), only_repeated=True), "repeat-seeds")
    texts = blocks.where("block is not null")
    own = texts.select("block", "number", "in_id", "in_text")  # one exchange for both uses
    reaches = _reaches(_suffixes(own, seeds, min_words, seed, bits), min_words, seed)
    windows = stash(_extended(own, seeds, reaches, min_words, seed, bits), "repeat-windows")
    flags = _compared(windows.where("entry_block is not null").select("entry_block", "entry_range", "hashes", "flags"), only_repeated=False)
    placed = windows.where("block is not null").select(F.col("block").alias("of"), "number", "doc_id", "n_words", "starts", "places")
    return texts, _spans(placed, flags, min_words)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, start, end, cut: spans of words that repeat in docs (doc_id, text).

    Words are counted from 0, end excluded; cut marks the spans of words that remove() takes
    away (a part of a repeated span, where its other part is a first occurrence).
    """
    found = _found(docs, min_words, seed, [])[1]
    each = lambda c, cut: found.select("doc_id", "n_words", F.explode(c).alias("span"), F.lit(cut).alias("cut"))
    return each("spans", False).unionByName(each("cuts", True)).select("doc_id", "n_words", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "cut")


def remove(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """docs, with all occurrences of repeated windows but the first cut from text.

    A text that is left without a word goes, and n_chars, if there is such a column, follows
    the text. All other columns stay as they are.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    texts, found = _found(docs, min_words, seed, carry)
    dealt = found.where(F.size("cuts") > 0).select(F.col("block").alias("of"), F.col("number").alias("place"), "cuts")
    kept = texts.drop("entry_block", "entry_range", "hashes", "flags")
    joined = kept.join(dealt, (kept["block"] == dealt["of"]) & (kept["number"] == dealt["place"]), "left").drop("of", "place", "number", "block")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [_without(t, c) for t, c in zip(batch.column("in_text").to_pylist(), batch.column("cuts").to_pylist(), strict=True)]
            rest = batch.drop_columns(["in_text", "cuts"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.string()), batch.column("cuts").is_valid()], [*rest.schema.names, "out_text", "was_cut"])

    kinds = [(n, t) for n, t in joined.dtypes if n not in ("in_text", "cuts")]
    done = joined.mapInArrow(cut, ", ".join([f"`{n}` {t}" for n, t in kinds] + ["out_text string, was_cut boolean"]))
    done = done.where(~F.col("was_cut") | F.col("out_text").rlike(r"[^\x20\x09-\x0D]"))

    def column(name: str) -> Column:
        if name in ("doc_id", "text"):
            return F.col("in_id" if name == "doc_id" else "out_text").cast(docs.schema[name].dataType).alias(name)
        own = F.col(f"in_{carry.index(name)}")
        return (F.when(F.col("was_cut"), F.length("out_text").cast(docs.schema[name].dataType)).otherwise(own) if name == "n_chars" else own).alias(name)

    return done.select(*map(column, docs.columns))


def _without(text: str | None, cuts: list[dict] | None) -> str | None:
    """text without the words of cuts, each with the white space after it."""
    if text is None or not cuts:
        return text
    from millrace.llm.words import Words

    raw = text.encode()
    w = Words([raw])
    out, at = [], 0
    for c in cuts:
        out.append(raw[at : w.starts[c["start"]]])
        at = int(w.starts[c["end"]]) if c["end"] < len(w.starts) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode()
