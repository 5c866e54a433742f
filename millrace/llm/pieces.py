"""Token ids of whole texts, with each different piece of text encoded once.

A tokenizer starts anew at most single spaces, so a text's ids are those of its pieces put
together, and a corpus has far fewer different pieces than pieces. Tasks cut texts into
blocks of bounded size: a block has its different pieces, and each text as numbers of
those. Pieces are dealt to buckets by hash; a bucket encodes its different pieces once and
gives each block the ids of its own; blocks then put their texts' ids together.

Everything between tasks is packed: a block's share of a bucket is one row.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash

#: Bytes of text in a block (one text may be longer), and of text for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 32 << 20, 24 << 20
#: Ids that are put together at once.
AT_ONCE = 1 << 20
#: Bytes of a piece that an encoder keeps beyond a batch.
LONGEST_KEPT = 64

#: Two characters of white space, or one at an end; for Python's re, and for Arrow's (RE2).
_ODD = re.compile(r"\s\s|^\s|\s$")
_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_ODD_RE2 = f"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^{|}~"
#: Letters that any version of Unicode has as such, in Arrow's regular expressions.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_SAFE = re.compile(r"(?<=\S) (?=\S)")

ENTRIES = "entry_block long, bucket int, numbers binary, entries binary"


def _numbered(lists):
    """Numbers of the lists' strings, the strings by number, and the bounds of the lists."""
    import numpy as np

    flat = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy()
    return flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist(), bounds - bounds[0]


def byte_level(texts) -> tuple[list, list[str]]:
    """For a tokenizer that puts a space before a word in the word's token: each text's numbers of pieces, and the pieces."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    odd = pc.match_substring_regex(texts, _ODD_RE2)
    plain, rest = np.flatnonzero(~odd.to_numpy(zero_copy_only=False)), np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    out: list = [None] * len(texts)
    numbers, known, bounds = _numbered(pc.split_pattern(texts.take(pa.array(plain)), " "))
    pieces = [" " + p for p in known]
    # the first piece of a text has no space before it
    firsts = pa.array(known, pa.string()).take(pa.array(numbers[bounds[:-1]])).dictionary_encode()
    numbers[bounds[:-1]] = firsts.indices.to_numpy() + len(pieces)
    pieces += firsts.dictionary.to_pylist()
    for n, i in enumerate(plain):
        out[i] = numbers[bounds[n] : bounds[n + 1]]
    lists = []
    for t in texts.take(pa.array(rest)).to_pylist():
        parts = _SAFE.split(t)
        lists.append([parts[0], *(" " + p for p in parts[1:])])
    if lists:
        numbers, known, bounds = _numbered(pa.array(lists, pa.list_(pa.string())))
        for n, i in enumerate(rest):
            out[i] = numbers[bounds[n] : bounds[n + 1]] + len(pieces)
        pieces += known
    return out, pieces


def at_spaces(texts) -> tuple[list, object]:
    """byte_level() with the pieces as Arrow's strings; plain texts are cut before line ends too."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.string())
    odd = pc.match_substring_regex(texts, _ODD_RE2).to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)) if len(rest) else texts, "\n", " \n"), " ")
    flat = lists.flatten().dictionary_encode()
    known, numbers = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    bounds = lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    pieces = [pc.if_else(pc.starts_with(known, "\n"), known, pc.binary_join_element_wise(" ", known, ""))]
    # the first piece of a text has no space before it
    firsts = known.take(pa.array(numbers[bounds[:-1]])).dictionary_encode()
    numbers[bounds[:-1]] = firsts.indices.to_numpy() + len(known)
    pieces.append(firsts.dictionary)
    out: list = [None] * len(texts)
    for n, i in enumerate(plain):
        out[i] = numbers[bounds[n] : bounds[n + 1]]
    if len(rest):
        parts = [_SAFE.split(t) for t in texts.take(pa.array(rest)).to_pylist()]
        numbers, listed, bounds = _numbered(pa.array([[own[0], *(" " + p for p in own[1:])] for own in parts], pa.list_(pa.string())))
        for n, i in enumerate(rest):
            out[i] = numbers[bounds[n] : bounds[n + 1]] + sum(map(len, pieces))
        pieces.append(pa.array(listed, pa.string()))
    return out, pa.concat_arrays(pieces)


def without_marks(pieces) -> tuple:
    """Pieces without a line end before them and marks after them, and where these are: which pieces have a line end, which have marks, and the marks.

    Only what a byte-level tokenizer parts too: one line end before a letter, and marks after a
    letter or digit. Apostrophes, which may begin a word with letters, are left where they are.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    headed = pc.starts_with(pieces, "\n")
    if pc.any(headed).as_py():
        headed = pc.and_(headed, pc.match_substring_regex(pieces, f"^\n[{_LATIN}]"))
        pieces = pc.if_else(headed, pc.utf8_slice_codeunits(pieces, 1), pieces)
    words = pc.utf8_rtrim(pieces, characters=_MARKS)
    marked = pc.less(pc.binary_length(words), pc.binary_length(pieces)).to_numpy(zero_copy_only=False)
    marked[marked] = pc.match_substring_regex(words.filter(pa.array(marked)), f"[0-9{_LATIN}]$").to_numpy(zero_copy_only=False)
    chosen = pa.array(marked)
    marks = pc.replace_substring_regex(pieces.filter(chosen), f"(?s)^.*[0-9{_LATIN}]", "")
    return pc.if_else(chosen, words, pieces), np.flatnonzero(headed.to_numpy(zero_copy_only=False)), np.flatnonzero(marked), marks


def spaceless(texts) -> tuple[list, list[str]]:
    """The same for a tokenizer that drops white space."""
    import pyarrow.compute as pc

    numbers, pieces, bounds = _numbered(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))
    return [numbers[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pieces


def cores(piece: str) -> list[str]:
    """A piece cut further at line ends and before a last comma or stop; its ids are those of the parts."""
    body = piece[1:] if piece[:1] == " " else piece
    if not body or body.isalpha() or _ODD.search(body):
        return [piece]
    lines = piece.split("\n")
    out = []
    for i, x in enumerate(lines):
        if i:
            out.append("\n")
        if len(x) > 2 and x[-1] in ",." and x[-2].isalpha():
            out += [x[:-1], x[-1]]
        else:
            out.append(x)
    return out


@lru_cache
def _squeezer(level: int):
    """This process's compressor; a new one for each row would cost more than its work."""
    import zstandard

    return zstandard.ZstdCompressor(level=level)


@lru_cache
def _expander():
    import zstandard

    return zstandard.ZstdDecompressor()


def _pack(arrays: list) -> bytes:
    """Integers as planes of their bytes, compressed; each array with its length."""
    import numpy as np

    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a, "<u4")
        out += [struct.pack("<I", len(a)), np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes()]
    return _squeezer(3).compress(b"".join(out))


def _unpack(data: bytes) -> list:
    import numpy as np

    raw = _expander().decompress(data)
    at, out = 4, []
    for _ in range(struct.unpack_from("<I", raw)[0]):
        n = struct.unpack_from("<I", raw, at)[0]
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at + 4).reshape(4, n).T).view("<u4").ravel())
        at += 4 + 4 * n
    return out


def lowered_cores(piece: str) -> list[str]:
    """cores() in lower case, for a tokenizer that lowers and normalises text itself.

    Further letters may become a letter and a mark (U+0130 is the first), which may belong to
    what stands after it in the tokenizer's eyes: pieces with such stay whole.
    """
    return cores(piece.lower()) if piece and max(piece) < "\u0130" else [piece]


def _pack_texts(texts: list[str]) -> bytes:
    import numpy as np

    raw = [t.encode() for t in texts]
    return _squeezer(1).compress(struct.pack("<I", len(raw)) + np.array([len(r) for r in raw], "<u4").tobytes() + b"".join(raw))


def _unpack_texts(data: bytes) -> list[str]:
    import numpy as np

    raw = _expander().decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b].decode() for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


class Encoder:
    """Encodes pieces, and keeps the ids of the most used ones, as arrays: most at most.

    A line end before a piece and marks after it are parted from it before it is looked up,
    where the tokenizer parts them too: the same word with and without them is one entry.
    """

    def __init__(self, tokenizer_file: str, parts_of: Callable[[str], list[str]] = cores, most: int = 1_000_000):
        import numpy as np
        import pyarrow as pa

        self.tokens, self.parts_of, self.most = tokens(tokenizer_file), parts_of, most
        self.parts_marks = parts_of is cores and not self.tokens.tokenizer_changes
        # entry 0 is the empty part
        self.texts, self.flat = pa.array([""]), np.zeros(0, np.int32)
        self.sizes, self.uses = np.zeros(1, np.int32), np.zeros(1, np.int64)

    def __call__(self, pieces: list[str], counts: list[int]) -> list[bytes]:
        """The ids of different pieces, which come counts times."""
        import numpy as np
        import pyarrow as pa

        sizes, flat = self.arrays(pa.array(pieces, pa.string()), np.asarray(counts))
        raw, ends = flat.tobytes(), np.cumsum(4 * sizes).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []

    def arrays(self, pieces, counts):
        """The same for Arrow's strings: how many ids each piece has, and the ids, one piece after the other."""
        import numpy as np
        import pyarrow as pa

        self._forget()
        if not self.parts_marks:
            entries = self._entries(pieces)
            self.uses += np.bincount(entries, counts, len(self.uses)).astype(np.int64)
            flat, ends = gathered(entries, *self._places(), self.flat)
            return self.sizes[entries], flat
        words, headed, marked, marks = without_marks(pieces)
        found = self._entries(pa.concat_arrays([pa.array(["\n"]), words, marks]))
        entries = np.zeros((len(pieces), 3), np.int64)
        entries[headed, 0], entries[:, 1], entries[marked, 2] = found[0], found[1 : 1 + len(words)], found[1 + len(words) :]
        self.uses += np.bincount(entries.ravel(), np.repeat(counts, 3), len(self.uses)).astype(np.int64)
        flat, ends = gathered(entries.ravel(), *self._places(), self.flat)
        return np.diff(ends[2::3], prepend=0), flat

    def _places(self):
        import numpy as np

        sizes = self.sizes.astype(np.int64)
        return np.cumsum(sizes) - sizes, sizes

    def _entries(self, parts):
        """The parts' entries, with new ones for those without."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        entries = pc.index_in(parts, value_set=self.texts)
        if not entries.null_count:
            return entries.to_numpy()
        absent = np.flatnonzero(entries.is_null().to_numpy(zero_copy_only=False))
        new = parts.take(pa.array(absent)).dictionary_encode()
        words = pc.match_substring_regex(new.dictionary, f"^ ?[{_LATIN}]+$").to_numpy(zero_copy_only=False)
        if not self.parts_marks or not self.tokens.tried(new.dictionary.filter(pa.array(words))):
            words = np.zeros(len(words), bool)
        order = np.argsort(~words, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) + len(self.texts)
        entries = entries.fill_null(0).to_numpy().astype(np.int64)
        entries[absent] = place[new.indices.to_numpy()]
        listed = new.dictionary.take(pa.array(order))
        sizes, ids = self.tokens.words(listed.slice(0, int(words.sum())))
        rest = self._encoded(listed.slice(int(words.sum())).to_pylist())
        self.texts = pa.concat_arrays([self.texts, listed])
        self.sizes = np.concatenate([self.sizes, sizes, np.fromiter(map(len, rest), np.int32, len(rest)) // 4])
        self.flat = np.concatenate([self.flat, ids, np.frombuffer(b"".join(rest), np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(order), np.int64)])
        return entries

    def _encoded(self, parts: list[str]) -> list[bytes]:
        # most are words of letters, which aren't cut further
        cut = {x: own for x in parts if not x[1:].isalpha() and (own := self.parts_of(x)) != [x]}
        if not cut:
            return self.tokens(parts)
        whole = list(dict.fromkeys(chain((x for x in parts if x not in cut), chain.from_iterable(cut.values()))))
        ids = dict(zip(whole, self.tokens(whole), strict=True))
        return [b"".join(map(ids.__getitem__, cut[x])) if x in cut else ids[x] for x in parts]

    def _forget(self) -> None:
        """Drops long entries, and the less used ones when there are too many."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        short = pc.binary_length(self.texts).to_numpy() <= LONGEST_KEPT
        if len(self.texts) <= self.most and short.all():
            return
        kept = np.flatnonzero(short)
        if len(kept) > self.most:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.most // 2]])
            self.uses = self.uses // 2  # later ones get their turn
        kept = np.concatenate([[0], kept[kept > 0]])
        self.flat = gathered(kept, *self._places(), self.flat)[0]
        self.texts, self.sizes, self.uses = self.texts.take(pa.array(kept)), self.sizes[kept], self.uses[kept]


@lru_cache(1)
def encoder(tokenizer_file: str) -> Encoder:
    """This process's encoder, over all its tasks."""
    return Encoder(tokenizer_file)


def gathered(numbers, starts, sizes, flat):
    """The ids of pieces by number, one after the other, and where each piece's end."""
    import numpy as np

    n = sizes[numbers]
    ends = np.cumsum(n)
    if not len(ends):
        return flat[:0], ends
    kind = np.int32 if max(len(flat), int(ends[-1])) < 2**31 else np.int64
    at = np.repeat((starts[numbers] - (ends - n)).astype(kind), n)
    at += np.arange(len(at), dtype=kind)
    return flat[at], ends


def blocks(docs: DataFrame, cut: Callable, block_bytes: int | None = None) -> DataFrame:
    """Rows of texts (block, number, doc_id, pieces), and of blocks' shares of buckets (ENTRIES); cut: byte_level or spaceless."""
    return stash(_cut(docs, cut, block_bytes or BLOCK_BYTES, True, True), "piece-blocks")


def unstashed_blocks(docs: DataFrame, cut: Callable, block_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """blocks() as two frames, texts and shares, that each cut docs anew: less disk, more work.

    docs must give the same rows in the same order each time, as a scan of files does; the
    job fails if it doesn't.
    """
    return _cut(docs, cut, block_bytes or BLOCK_BYTES, True, False), shares_of(_cut(docs, cut, block_bytes or BLOCK_BYTES, False, True))


def _content(doc_ids, texts) -> int:
    """A hash of a block's rows, which is its number: shares meet texts only if they are of the same rows."""
    import numpy as np
    import xxhash

    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    h = xxhash.xxh3_64(doc_ids.fill_null(-1).to_numpy().tobytes() + (ends - ends[0]).tobytes())
    if texts.buffers()[2] is not None:
        h.update(memoryview(texts.buffers()[2])[int(ends[0]) : int(ends[-1])])
    return h.intdigest() >> 1


def _cut(docs: DataFrame, cut: Callable, block_bytes: int, with_texts: bool, with_shares: bool) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, size // BUCKET_BYTES)

    def split(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        size, held = 0, []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names = ["block", "number", "doc_id", "pieces", "entry_block", "bucket", "numbers", "entries"]

        def whole() -> Iterator:
            t = pa.Table.from_batches(held).combine_chunks()
            if not len(t):
                return
            texts = t["text"].chunk(0).fill_null("")
            block = _content(t["doc_id"].chunk(0), texts)
            numbers, listed = cut(texts)
            if with_texts:
                own = [pa.array([block] * len(numbers), pa.int64()), pa.array(range(len(numbers)), pa.int64()), t["doc_id"].chunk(0), pa.array([_pack([x]) for x in numbers], pa.binary())]
                yield pa.RecordBatch.from_arrays(own + [pa.nulls(len(numbers), k) for k in kinds[4:]], names)
            if not with_shares:
                return
            # pieces with the same first part (see cores) have the same bucket
            place = np.fromiter((zlib.crc32(p.partition("\n")[0].rstrip(",.").lower().encode()) for p in listed), np.int64, len(listed)) % buckets
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order])) + 1
            for some in np.split(order, cuts):
                if len(some):
                    own = [pa.array([block]), pa.array([int(place[some[0]])], pa.int32()), pa.array([_pack([some])], pa.binary()), pa.array([_pack_texts([listed[i] for i in some])], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in kinds[:4]] + own, names)

        for batch in batches:
            first = 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            while first < len(batch):
                done = sizes[first - 1] if first else 0
                last = int(np.searchsorted(sizes, done + block_bytes - size)) + 1
                some = batch.slice(first, last - first)
                held.append(some)
                first += len(some)
                size += int(sizes[first - 1] - done)
                if size >= block_bytes:
                    yield from whole()
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from whole()
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker lives on, and its memory counts

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(split, f"block long, number long, doc_id long, pieces binary, {ENTRIES}")


def shares_of(found: DataFrame) -> DataFrame:
    return found.where("entry_block is not null").select("entry_block", "bucket", "numbers", "entries")


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: those that print stand for themselves, others follow from 256 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokens:
    """The ids of parts of text by a tokenizers file.

    A part that is one word of letters needs no search for words: it goes to the tokenizer's
    model as it is written in the vocabulary. That the ids are the same is tried on the
    first parts; if they aren't, all parts take the whole way.
    """

    TRIED = 2000

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        #: Whether text is changed (lower case, normal form) before it is cut into words.
        self.tokenizer_changes = self.tokenizer.normalizer is not None
        self.letters, self.trials, self.direct = _byte_letters(), 0, True

    def _whole(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for i in range(0, len(parts), 20_000) for e in self.tokenizer.encode_batch_fast(parts[i : i + 20_000], add_special_tokens=False)]

    def _words(self, parts: list[str]) -> list[bytes]:
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(p)]).tobytes() for p in self._written(parts)]

    def _written(self, parts: list[str]) -> list[str]:
        letters, space = self.letters, self.letters[32]
        return [p if p.isascii() and p[0] != " " else space + p[1:] if p.isascii() else p.encode().decode("latin-1").translate(letters) for p in parts]

    def tried(self, words) -> bool:
        """Whether words may go to the model as they are; tries the first of these (Arrow's strings) if too few were tried."""
        if self.direct and self.trials < self.TRIED:
            self(words.slice(0, self.TRIED).to_pylist())
        return self.direct

    def words(self, words):
        """How many ids each of Arrow's strings has, words of letters with or without a space before them, and all ids."""
        import numpy as np

        tokenize, sizes, ids = self.tokenizer.model.tokenize, [], [np.zeros(0, np.int32)]
        for i in range(0, len(words), 10_000):
            found = list(map(tokenize, self._written(words.slice(i, 10_000).to_pylist())))
            sizes += map(len, found)
            ids.append(np.array([t.id for own in found for t in own], np.int32))
        return np.array(sizes, np.int32), np.concatenate(ids)

    def _words_of(self, parts: list[str]) -> list[str]:
        if self.tokenizer_changes:
            return [p for p in parts if p.isalpha() and p == p.lower() and is_normalized("NFC", p)]
        return [p for p in parts if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) or p.isalpha()]

    def __call__(self, parts: list[str]) -> list[bytes]:
        words = self._words_of(parts) if self.direct else []
        found = dict(zip(words, self._words(words), strict=True))
        if self.trials < self.TRIED and words:
            tried = words[: self.TRIED]
            self.trials += len(tried)
            if self._whole(tried) != [found[p] for p in tried]:
                self.direct, found = False, {}
        rest = [p for p in parts if p not in found]
        found.update(zip(rest, self._whole(rest), strict=True))
        return [found[p] for p in parts]


@lru_cache(2)
def tokens(tokenizer_file: str) -> Tokens:
    """This process's tokenizer."""
    return Tokens(tokenizer_file)


def with_tokenizer(shares: DataFrame, tokenizer_file: str, parts_of: Callable[[str], list[str]] = cores) -> DataFrame:
    """shares (ENTRIES), with the ids of their pieces as entries."""

    def encode(t):
        import pyarrow as pa

        return pa.table({"entry_block": t["entry_block"], "bucket": t["bucket"], "numbers": t["numbers"], "entries": pa.array(_resolved(t["entries"].to_pylist(), tokens(tokenizer_file), parts_of), pa.binary())})

    return shares.groupBy("bucket").applyInArrow(encode, ENTRIES)


def _resolved(rows: list[bytes], ids_of: Callable, parts_of: Callable[[str], list[str]]) -> list[bytes]:
    """For each row of packed pieces: sizes and ids of its pieces, packed. ids_of encodes parts that weren't met before."""
    import numpy as np

    ids: dict[str, bytes] = {}
    known: dict[str, bytes] = {}
    out = []
    for row in rows:
        pieces = _unpack_texts(row)
        new = [p for p in pieces if p not in ids]
        parts = [parts_of(p) for p in new]
        missing = list({x for own in parts for x in own if x not in known})
        known.update(zip(missing, ids_of(missing), strict=True))
        ids.update((p, b"".join(map(known.__getitem__, own))) for p, own in zip(new, parts, strict=True))
        found = list(map(ids.__getitem__, pieces))
        out.append(_pack([np.array([len(x) // 4 for x in found], np.uint32), np.frombuffer(b"".join(found), "<u4")]))
    return out


def put_together(found: DataFrame, shares: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(doc_ids, ids as bytes) for runs of texts of blocks(), with shares that hold their pieces' ids.

    finish returns a pyarrow table of schema.
    """

    def assemble(texts, entries):
        import numpy as np
        import pyarrow as pa

        if not texts.num_rows:
            return finish([], [])
        if not entries.num_rows:
            raise RuntimeError("the texts differ between two readings")
        texts = texts.take(pa.array(np.argsort(texts["number"].to_numpy(), kind="stable")))
        numbers, sizes, flat = [], [], []
        for n, e in zip(entries["numbers"].to_pylist(), entries["entries"].to_pylist(), strict=True):
            numbers.append(_unpack(n)[0])
            own, ids = _unpack(e)
            sizes.append(own)
            flat.append(ids)
        numbers, sizes = np.concatenate(numbers), np.concatenate(sizes).astype(np.int64)
        flat = np.concatenate(flat)
        starts = np.empty(len(numbers), np.int64)
        starts[numbers] = np.cumsum(sizes) - sizes
        by_number = np.empty(len(numbers), np.int64)
        by_number[numbers] = sizes
        tables, doc_ids, held, n_held = [], [], [], 0

        def flush() -> None:
            own = np.concatenate(held)
            ids, ends = gathered(own, starts, by_number, flat)
            bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, held)])].tolist()
            raw = memoryview(ids.tobytes())
            tables.append(finish(doc_ids, [bytes(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]))

        for doc_id, packed in zip(texts["doc_id"].to_pylist(), texts["pieces"].to_pylist(), strict=True):
            doc_ids.append(doc_id)
            held.append(_unpack(packed)[0])
            n_held += len(held[-1])
            if n_held * 2 >= AT_ONCE:
                flush()
                doc_ids, held, n_held = [], [], 0
        if held:
            flush()
        return pa.concat_tables(tables)

    texts = found.where("block is not null").select(F.col("block").alias("of"), "number", "doc_id", "pieces")
    return texts.groupBy("of").cogroup(shares.groupBy("entry_block")).applyInArrow(assemble, schema)


def ids_only(doc_ids: list, ids: list[bytes]):
    import pyarrow as pa

    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids, pa.binary())})


def encode(docs: DataFrame, tokenizer_file: str, drops_space: bool, finish: Callable = ids_only, schema: str = "doc_id long, ids binary") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of each row of docs, or what finish makes of them."""
    found = blocks(docs, spaceless if drops_space else byte_level)
    return put_together(found, with_tokenizer(shares_of(found), tokenizer_file, lowered_cores if drops_space else cores), finish, schema)
