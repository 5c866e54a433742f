"""Operator 11, substring dedup: super-k-mer partitioning.

A window is WINDOW consecutive words of one document. A word goes if it lies in a window whose
words, in their order, also start in a document with a smaller doc_id.

1. A window's minimiser is the (first) place in it where the hash of the next MINIMISER words
   is least. Consecutive windows that share it are a super-k-mer: they travel as one packed
   string of words to the bucket of the minimiser's hash, so equal windows meet, and a word
   travels some three times, not WINDOW times.
2. Texts lie in blocks of bounded size, dealt by a hash of the row. A block sends each different
   super-k-mer once, with the first and the last doc_id that it has there, so copies in any
   number are an entry of each block.
3. A bucket sorts the windows of its strings (by hash, equal hashes by their bytes compared) and
   so finds each one's smallest doc_id, exactly.
4. A block gets those of its super-k-mers back that have a window with a smaller doc_id, with
   the smallest of each window, and takes the words out.

A minimiser with many different windows around it (a phrase that many texts have) would make its
bucket large. Minimisers are therefore counted in bins first, over all texts; windows of a bin
that has HOT_TIMES the mean or more are dealt each by itself, by a hash of all its words. Equal
windows have equal minimisers, so they still meet. Bins grow in number with the corpus.

Defined cases: null and empty texts, and those of fewer than WINDOW words, stay as they are (as
words joined by one space); rows that share a doc_id are one document, so they take nothing from
each other, and rows that repeat are treated alike; a row without doc_id counts as after all
others; ties between places of a window go to the first; a text of any length is worked on
whole, some words at a time; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash

WINDOW, MINIMISER = 13, 3
#: Bytes of text in a block, and of packed strings in a bucket (about three times the text).
BLOCK_BYTES, BUCKET_BYTES, PACKED_TIMES = 8 << 20, 24 << 20, 3
#: Blocks and buckets of a smaller corpus, and bins for each bucket.
LEAST_PARTS, LEAST_BINS, BINS_PER_BUCKET = 64, 1 << 16, 16
#: Times the mean, and super-k-mers, from which a bin counts as hot.
HOT_TIMES, HOT_LEAST = 8, 1000
#: Bins whose counts a task holds.
HELD_BINS = 1 << 20
#: Level of zstandard for what travels.
LEVEL = 6
#: What stands for no doc_id: after all others.
LAST = 2**63 - 1

ENTRIES = "of_block long, bucket long, strings binary, firsts binary, lasts binary"
ANSWERS = "of_block long, strings binary, firsts binary"
RESULT = "doc_id long, n_words long, n_removed long, kept string"


class Cut:
    """The super-k-mers of some texts, and their words joined by one space each.

    Super-k-mer i begins with word first[i] and has windows[i] windows; word j's bytes are
    plain[starts[j] : ends[j]].
    """

    def __init__(self, texts: list[bytes], width: int, minimiser: int):
        import numpy as np

        from millrace.llm.words import Words, minimisers

        w = Words(texts)
        self.width, self.bounds, self.n_words = width, w.bounds, len(w.starts)
        keep = ~w.space
        keep[w.ends] = True  # a space after each word
        self.bytes = np.where(w.space, np.uint8(32), w.buf)[keep]
        self.plain = self.bytes.tobytes()
        self.sizes = w.ends - w.starts + 1
        self.ends = np.cumsum(self.sizes) - 1
        self.starts = self.ends + 1 - self.sizes
        self.seeds = w.spans(minimiser)
        at = minimisers(self.seeds, width - minimiser + 1)
        stops = np.repeat(w.bounds[1:], np.diff(w.bounds))
        windows = np.flatnonzero(np.arange(len(at)) + width <= stops[: len(at)])
        of = at[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (of[1:] != of[:-1]) | (windows[1:] != windows[:-1] + 1)
        begins = np.flatnonzero(new)
        self.first = windows[begins]
        self.windows = np.diff(np.concatenate([begins, [len(windows)]])).astype(np.int64)
        self.hashes = self.seeds[of[begins]]
        self.whole = w.spans(width)  # of windows, by their first word

    def bins(self, n: int):
        import numpy as np

        return (self.hashes % np.uint64(n)).astype(np.int64)

    def dealt(self, hot, n_bins: int, buckets: int):
        """(first word, windows, bucket) of what travels: super-k-mers, and the windows of hot bins (sorted) by themselves."""
        import numpy as np

        bins = self.bins(n_bins)
        alone = np.zeros(len(bins), bool) if not len(hot) else hot[np.minimum(np.searchsorted(hot, bins), len(hot) - 1)] == bins
        if not alone.any():
            return self.first, self.windows, bins % buckets
        n = np.where(alone, self.windows, 1)
        each = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        first = self.first[each] + step
        single = alone[each]
        by_window = (self.whole[np.where(single, first, 0)] % np.uint64(buckets)).astype(np.int64)
        return first, np.where(single, 1, self.windows[each]), np.where(single, by_window, bins[each] % buckets)


def _hot_bins(texts: DataFrame, n_bins: int, width: int, minimiser: int):
    """The bins with HOT_TIMES the mean or more super-k-mers, sorted: at most n_bins / HOT_TIMES."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        from millrace.llm.words import chunks

        held: list = []

        def merged():
            bins, at = np.unique(np.concatenate([b for b, _ in held]), return_inverse=True)
            return bins, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows():
            bins, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], ["bin", "n"])

        for batch in batches:
            for _, part in chunks((t or "").encode() for t in batch.column(0).to_pylist()):
                held.append(np.unique(Cut(part, width, minimiser).bins(n_bins), return_counts=True))
                if len(held) >= 16:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD_BINS:
                        yield rows()
                        held.clear()
        if held:
            yield rows()

    counts = stash(texts.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")), "minimisers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= max(HOT_LEAST, HOT_TIMES * total // n_bins)).select("bin").toArrow()
    return np.sort(hot["bin"].to_numpy())


def _squeezed(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress(x)


def _numbers(x: bytes):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8")


def _strings(x: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x).split(b"\n")


def _in_order(t):
    """doc_ids (LAST for none) and texts of a block's rows, by doc_id, and the rows' order."""
    import numpy as np

    ids = t["doc_id"].fill_null(LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    t = t.take(order)
    return ids[order], [(x or "").encode() for x in t["text"].to_pylist()], t


def _entries(t, hot, n_bins: int, buckets: int, width: int, minimiser: int):
    """ENTRIES of a block."""
    import numpy as np
    import pyarrow as pa

    from millrace.llm.words import chunks

    ids, raw, _ = _in_order(t)
    found: dict[bytes, list] = {}
    for at, part in chunks(raw):
        c = Cut(part, width, minimiser)
        first, windows, bucket = c.dealt(hot, n_bins, buckets)
        doc = ids[at + np.searchsorted(c.bounds, first, side="right") - 1]
        plain = c.plain
        for s, e, b, d in zip(c.starts[first].tolist(), c.ends[first + windows + width - 2].tolist(), bucket.tolist(), doc.tolist(), strict=True):
            key = plain[s:e]
            held = found.get(key)
            if held is None:
                found[key] = [b, d, d]
            else:
                held[2] = d
    strings = list(found)
    held = np.array(list(found.values()), np.int64).reshape(-1, 3)
    order = np.argsort(held[:, 0], kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(held[order, 0])) + 1) if len(order) else []
    block = t["block"][0].as_py() if t.num_rows else 0
    packed = [pa.array([_squeezed(b"\n".join([strings[i] for i in p.tolist()])) for p in parts], pa.binary())]
    # first doc_ids ascend in a block: their steps are small
    packed += [pa.array([_squeezed(x(held[p]).astype("<i8").tobytes()) for p in parts], pa.binary()) for x in (lambda h: np.diff(h[:, 1], prepend=0), lambda h: h[:, 2] - h[:, 1])]
    return pa.table([pa.array([block] * len(parts), pa.int64()), pa.array([int(held[p[0], 0]) for p in parts], pa.int64()), *packed], names=[x.split()[0] for x in ENTRIES.split(", ")])


def _equal(buf, a, b, size):
    """Whether size bytes from a on equal those from b on, for each of some pairs."""
    import numpy as np

    out = np.ones(len(a), bool)
    for i in range(0, len(a), 1 << 14):
        n = size[i : i + (1 << 14)]
        ends = np.cumsum(n)
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        differ = buf[np.repeat(a[i : i + (1 << 14)], n) + step] != buf[np.repeat(b[i : i + (1 << 14)], n) + step]
        out[i : i + (1 << 14)] = np.add.reduceat(differ, ends - n) == 0
    return out


def ranked(buf, hashes, start, size):
    """An order of windows (bytes of buf) in which equal ones are neighbours, and whether each equals the one before."""
    import numpy as np

    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(order), bool)
    near = np.flatnonzero(hashes[order][1:] == hashes[order][:-1]) + 1
    if not len(near):
        return order, same
    a, b = order[near - 1], order[near]
    alike = size[a] == size[b]
    alike[alike] = _equal(buf, start[a][alike], start[b][alike], size[a][alike])
    same[near] = alike
    if not alike.all():  # different windows of one hash: those runs are sorted by their bytes
        run = np.cumsum(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        for r in np.unique(run[near[~alike]]).tolist():
            places = np.flatnonzero(run == r)
            words = sorted((buf[start[i] : start[i] + size[i]].tobytes(), i) for i in order[places].tolist())
            order[places] = [i for _, i in words]
            same[places] = [False] + [x == y for (x, _), (y, _) in zip(words, words[1:], strict=False)]
    return order, same


def _counted(t, width: int):
    """ANSWERS of a bucket: of each block's strings, those with a window that starts in a smaller doc_id than the block's last."""
    import numpy as np
    import pyarrow as pa

    from millrace.llm.words import Words, chunks

    strings, firsts, lasts, of = [], [], [], []
    for i, (s, f, n) in enumerate(zip(t["strings"].to_pylist(), t["firsts"].to_pylist(), t["lasts"].to_pylist(), strict=True)):
        strings += _strings(s)
        firsts.append(np.cumsum(_numbers(f)))
        lasts.append(firsts[-1] + _numbers(n))
        of.append(np.full(len(firsts[-1]), i))
    firsts, lasts, of = map(np.concatenate, (firsts, lasts, of))
    buf = np.frombuffer(b"\n".join(strings) + b"\n", np.uint8)
    hashes, start, size, entry, base = [], [], [], [], 0
    for at, part in chunks(strings):
        w = Words(part)
        stops = np.repeat(w.bounds[1:], np.diff(w.bounds))
        own = np.flatnonzero(np.arange(len(stops)) + width <= stops)
        hashes.append(w.spans(width)[own])
        start.append(base + w.starts[own])
        size.append(w.ends[own + width - 1] - w.starts[own])
        entry.append(at + np.searchsorted(w.bounds, own, side="right") - 1)
        base += len(w.buf)
    hashes, start, size, entry = map(np.concatenate, (hashes, start, size, entry))
    order, same = ranked(buf, hashes, start, size)
    least = np.empty(len(order), np.int64)
    begins = np.flatnonzero(~same)
    least[order] = np.repeat(np.minimum.reduceat(firsts[entry[order]], begins), np.diff(np.concatenate([begins, [len(order)]])))
    wanted = np.zeros(len(firsts), bool)
    wanted[entry[least < lasts[entry]]] = True
    rows = []
    for i in np.unique(of[wanted]).tolist():
        picked = np.flatnonzero(wanted & (of == i))
        a, b = np.searchsorted(entry, picked), np.searchsorted(entry, picked, side="right")
        mine = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        rows.append({"of_block": t["of_block"][i].as_py(), "strings": _squeezed(b"\n".join([strings[j] for j in picked.tolist()])), "firsts": _squeezed(least[mine].astype("<i8").tobytes())})
    return pa.Table.from_pylist(rows, schema=pa.schema([("of_block", pa.int64()), ("strings", pa.binary()), ("firsts", pa.binary())]))


def _taken_out(t, answers, hot, n_bins: int, buckets: int, width: int, minimiser: int):
    """RESULT of a block."""
    import numpy as np
    import pyarrow as pa

    from millrace.llm.words import chunks

    ids, raw, t = _in_order(t)
    known: dict[bytes, object] = {}
    for s, f in zip(answers["strings"].to_pylist(), answers["firsts"].to_pylist(), strict=True):
        at, firsts = 0, _numbers(f)
        for x in _strings(s):
            n = x.count(b" ") + 2 - width
            known[x] = firsts[at : at + n]
            at += n
    n_words, n_removed, kept = [], [], []
    for at, part in chunks(raw):
        c = Cut(part, width, minimiser)
        cover = np.zeros(c.n_words + 1, np.int64)
        if known and len(c.first):
            first, windows, _ = c.dealt(hot, n_bins, buckets)
            plain = c.plain
            firsts = [known.get(plain[s:e]) for s, e in zip(c.starts[first].tolist(), c.ends[first + windows + width - 2].tolist(), strict=True)]
            some = np.array([i for i, x in enumerate(firsts) if x is not None], np.int64)
            if len(some):
                n = windows[some]
                doc = ids[at + np.searchsorted(c.bounds, first[some], side="right") - 1]
                begin = np.repeat(first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                gone = begin[np.concatenate([firsts[i] for i in some.tolist()]) < np.repeat(doc, n)]
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + width, -1)
        stays = np.cumsum(cover)[:-1] == 0
        left = c.bytes[np.repeat(stays, c.sizes)].tobytes()
        words = np.concatenate([[0], np.cumsum(stays)])[c.bounds]
        ends = np.concatenate([[0], np.cumsum(np.where(stays, c.sizes, 0))])[c.bounds].tolist()
        n_words += np.diff(c.bounds).tolist()
        n_removed += (np.diff(c.bounds) - np.diff(words)).tolist()
        kept += [left[a : b - 1] if b > a else b"" for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table([t["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, width: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each row of docs (doc_id, text)."""
    if not 1 <= minimiser <= width:
        raise ValueError("1 <= minimiser <= width")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks, buckets = (max(LEAST_PARTS, x) for x in (size // BLOCK_BYTES, PACKED_TIMES * size // BUCKET_BYTES))
    n_bins = max(LEAST_BINS, 1 << (BINS_PER_BUCKET * buckets).bit_length())
    shared = docs.sparkSession.sparkContext.broadcast(_hot_bins(plain, n_bins, width, minimiser))
    # a row's block is told by the row itself, so it is the same however often rows are read; rows too short for a window may lie anywhere
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * width - 1
    block = F.pmod(F.when(short, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id", "text")), F.lit(blocks))
    texts = plain.withColumn("block", block)

    def cut(t):
        return _entries(t, shared.value, n_bins, buckets, width, minimiser)

    def put_back(t, answers):
        return _taken_out(t, answers, shared.value, n_bins, buckets, width, minimiser)

    entries = texts.groupBy("block").applyInArrow(cut, ENTRIES)
    answers = entries.groupBy("bucket").applyInArrow(lambda t: _counted(t, width), ANSWERS)
    return texts.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(put_back, RESULT)
