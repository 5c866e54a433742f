"""Operators 1, 7 and 9 against the tokenizers themselves."""

import hashlib
import zlib
from collections import defaultdict

import pytest

numpy = pytest.importorskip("numpy")
P = pytest.importorskip("public_tokenizers")

from millrace.llm import bpe, packing, pieces, token_files  # noqa: E402
from millrace.llm.shared import shared_path  # noqa: E402


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 100_000)


def encoded(rows, file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(file))
    t.encode_special_tokens = True
    return [numpy.array([*e.ids, 2], "<u4").tobytes() for e in t.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]


def test_binary_lengths():
    for n in range(1, 300):
        got = packing.binary_lengths(n, 32)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 32 for x in got) and got == sorted(got, reverse=True)
        assert len(got) == n // 32 + (n % 32).bit_count()


def test_packing(documents, rows):
    got = packing.packing_digest(documents, P.path("word_bpe_49k.json"), longest=256).collect()
    want = defaultdict(list)
    for r, ids in zip(rows, encoded(rows, "word_bpe_49k.json"), strict=True):
        n, at = len(ids) // 4, 0
        for length in packing.binary_lengths(n, 256):
            want[r.doc_id].append((at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n))
            at += length
    have = defaultdict(list)
    for g in got:
        have[g.doc_id].append((g.start, g.length, g.ids_crc32, g.doc_tokens))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert sorted(g.sequence_id for g in got) == list(range(len(got))) and {g.offset for g in got} == {0}
    by_sequence = sorted((g.sequence_id, -g.length) for g in got)
    assert [x for _, x in by_sequence] == sorted(x for _, x in by_sequence)  # equal lengths lie together


def test_packed_ids(documents, rows):
    got = packing.pack(documents, P.path("word_bpe_49k.json")).where("doc_id = 1000006").orderBy("start").collect()
    want = next(e for r, e in zip(rows, encoded(rows, "word_bpe_49k.json"), strict=True) if r.doc_id == 1_000_006)
    assert b"".join(bytes(g.ids) for g in got) == want


def test_token_files(spark, documents, rows):
    got = token_files.write_and_digest(documents, P.path("byte_bpe_50k.json")).collect()
    ids = sorted(zip([r.doc_id for r in rows], encoded(rows, "byte_bpe_50k.json"), strict=True), key=lambda x: (x[0] is not None, x[0] or 0))
    want, at = [], 0
    for doc_id, x in ids:
        want.append((doc_id, at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert sorted((g.start, g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == sorted((s, d, n, c) for d, s, n, c in want)


def test_places_are_those_in_the_files(spark):
    """Repeated ids with different texts, read straight from the files."""
    from glob import glob

    from pyarrow import orc

    texts = ["a b c d e f g h", "x y", "one two three four five six", "z", "k k k", "m n o p q r s t u v"] * 3
    df = spark.createDataFrame([*((5, t) for t in texts), (3, "q"), (None, "w w"), (9, None), (5, "x" * 300_000)], "doc_id long, text string").repartition(4)
    path = shared_path(spark, "token-places")
    token_files.write_tokens(df, path, P.path("byte_bpe_50k.json"))
    want, at = [], 0
    for f in sorted(glob(path.removeprefix("file:") + "/part*.orc")):
        t = orc.read_table(f)
        for d, i in zip(t["doc_id"].to_pylist(), t["ids"].to_pylist(), strict=True):
            want.append((d, at, len(i), zlib.crc32(numpy.array(i, "<u4").tobytes())))
            at += len(i)
    assert sorted(map(tuple, token_files.token_digest(spark, path).collect()), key=str) == sorted(want, key=str)


def test_token_files_are_searched_by_metadata(spark, documents):
    path = shared_path(spark, "token-files")
    token_files.write_tokens(documents, path, P.path("byte_bpe_50k.json"))
    one = token_files.read_tokens(spark, path, [1_000_006])
    assert "PushedFilters: [In(doc_id" in one._sc._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted").replace("In(`doc_id`", "In(doc_id") or one.count() == 1
    assert one.count() == 1 and len(one.first().ids) > 30_000


def test_bpe(documents, rows):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    tokenizer = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = tokenizer.encode_ordinary(r.text or "")
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(numpy.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bpe.encoding_digest(documents, path, P.PATTERN).collect()
    assert sorted((g.doc_id or -1, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)


def long_words():
    import base64
    import random

    rng = random.Random(6)
    common = "the of and in to was thing water house green letter morning river table winter garden nation".split()
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = [
        lambda n: "".join(rng.choices(letters, k=n)), lambda n: "".join(rng.choices(common, k=n // 5)), lambda n: rng.choice("ab-=*") * n, lambda n: ("".join(rng.choices("abc", k=rng.randint(2, 9))) * n)[:n],
        lambda n: base64.b64encode(rng.randbytes(n)).decode(), lambda n: "".join(chr(rng.randint(0x4E00, 0x4F00)) for _ in range(n // 3)),
    ]
    return rng, kinds


def test_long_words_are_folded_in_windows():
    """Windows put together, and the heap, give the ids that the library gives."""
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    of = bpe._ranks(path)
    sizes = numpy.array([len(x) for x in bpe.read_ranks(path)])
    library = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=of, special_tokens={})
    rng, kinds = long_words()
    apart = 0
    for i in range(600):
        word = kinds[i % len(kinds)](rng.randint(150, 1500)).encode()
        want = numpy.array(library.encode_ordinary(word.decode()), "<u4").tobytes()
        assert bpe.merged(word, of) == want
        got = bpe.stitched([bpe.merged(x, of) for x in bpe.windows(word)], sizes)
        apart += got is None
        assert got in (None, want)
    assert apart < 6
    assert bpe.stitched([numpy.array([1, 2], "<u4").tobytes(), numpy.array([3], "<u4").tobytes()], sizes) is None


def test_words_of_any_length(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe._ranks(path), special_tokens={})
    rng, kinds = long_words()
    texts = [f"a {kinds[i % len(kinds)](n)} b" for i, n in enumerate([200_000, 200_000, 200_000, 3000, 900, 20_000])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode(df, path, P.PATTERN).collect()}
    assert got == {i: numpy.array(library.encode_ordinary(t), "<u4").tobytes() for i, t in enumerate(texts)}


def test_decoding_gives_the_texts(documents, rows):
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(documents, path, P.PATTERN), path).collect()
    assert sorted((g.doc_id or -1, bytes(g.decoded)) for g in got) == sorted((r.doc_id or -1, (r.text or "").encode()) for r in rows)


def test_cores_are_safe_cuts():
    from tokenizers import Tokenizer

    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(P.path(file))
        for p in (" word,", "re.\nErtion", " a.\nb,", " $,", "x..", " it's.", "\n", "", " é,", " 12,", "a\n\nb."):
            parts = pieces.cores(p)
            assert "".join(parts) == p
            assert [i for x in parts for i in t.encode(x, add_special_tokens=False).ids] == t.encode(p, add_special_tokens=False).ids


def test_words_go_the_direct_way(rows):
    from tokenizers import Tokenizer

    words = sorted({w for r in rows for w in (r.text or "").split()} | {"Σίσυφος", "e\u0301te", "İx", "straße", "ﬁn", "ALLCAPS"})
    for file, space in (("byte_bpe_50k.json", " "), ("word_bpe_49k.json", "")):
        t = Tokenizer.from_file(P.path(file))
        parts = [space + w for w in words] + words
        want = [numpy.array(e.ids, "<u4").tobytes() for e in t.encode_batch(parts, add_special_tokens=False)]
        ids = pieces.Tokens(P.path(file))
        assert ids(parts) == want and ids.direct
        kept = pieces.Encoder(P.path(file), most=50)
        for _ in range(3):
            assert kept(parts, [i % 3 for i in range(len(parts))]) == want
    wrong = pieces.Tokens(P.path("byte_bpe_50k.json"))
    wrong.letters = {**wrong.letters, 32: "x"}
    assert wrong(["there", " once"]) == pieces.Tokens(P.path("byte_bpe_50k.json"))._whole(["there", " once"]) and not wrong.direct


def test_empty_tables(empty):
    assert packing.packing_digest(empty, P.path("word_bpe_49k.json")).count() == 0
    assert token_files.write_and_digest(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.encoding_digest(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_texts_that_change_between_readings_fail(spark):
    from pyspark.errors import PySparkException

    def anew(batches):
        import os

        for b in batches:
            yield b.assign(doc_id=b["id"], text=[os.urandom(5).hex() for _ in range(len(b))])[["doc_id", "text"]]

    df = spark.range(100).mapInPandas(anew, "doc_id long, text string")
    with pytest.raises(PySparkException, match="two readings"):
        bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()


#: Letters that change when lowered or normalised, marks, ligatures, odd spaces, and what stands beside words.
ODD = [*"aeioutnshlZQMÉéèüßİıſKÅﬁﬂªº½٣पकि中文字か한ςЖж,.;:!?'\"()-_&$#@%019 ", "  ", "\n", "\t", " ", " ", "　", "\u0085", "​", "﻿", "́", "̇", "̨", "‍", "😀", "'s", "<|endoftext|>", "\x1c", "\x00", "\r\n", "İ.", "İ,", "é.", "a,\nb."]


@pytest.mark.parametrize("file,cut,parts", [("word_bpe_49k.json", pieces.spaceless, pieces.lowered_cores), ("byte_bpe_50k.json", pieces.byte_level, pieces.cores)])
def test_pieces_of_odd_texts_have_the_texts_ids(file, cut, parts):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(10_000)]
    t = Tokenizer.from_file(P.path(file))
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    numbers, listed = cut(pa.array(texts))
    ids = pieces.Encoder(P.path(file), parts)(listed, [2] * len(listed))
    assert [numpy.frombuffer(b"".join(ids[j] for j in own), "<u4").tolist() for own in numbers] == want


def test_arrays_of_pieces_have_the_texts_ids():
    """op7's way, in batches of one encoder that forgets."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(9)
    odd = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    words = ["there", "niño", "größe", "été", "Жук", "Σίσυφος", "naïve", "A1", "12", "it's", "x'", "it''", "a_", "×", "straße", "中文", "e\u0301", "Iª", "xº", "\u017f", "\u0180", "y" * 80]
    marks = ["", "", ",", ".", "!!", "$$$", ".%%%", "'", "'s,", ",'", "_", "_.", "€,", "…", ")", "?!", "\u0301,", "!" * 90]
    plain = ["".join(rng.choice([" ", " ", "\n", "\t", "\u00a0"]) * (i > 0) + rng.choice(["", "", "(", "'"]) + rng.choice(words) + rng.choice(marks) for i in range(rng.randint(1, 30))) for _ in range(4000)]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    kept = pieces.Encoder(P.path("byte_bpe_50k.json"), most=300)
    for texts in (odd[:2000], plain[:2000], odd[2000:] + plain[2000:], [""], ["  "], [" a", "b ", "\n\nc"], plain[:2000]):
        numbers, listed = pieces.at_spaces(pa.array(["left out", *texts]).slice(1))
        sizes, flat = kept.arrays(listed, numpy.bincount(numpy.concatenate(numbers), minlength=len(listed)))
        own = numpy.split(flat, numpy.cumsum(sizes)[:-1])
        assert [[i for j in row for i in own[j].tolist()] for row in numbers] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    kept([], [])
    assert len(kept.texts) <= 300


def test_words_are_encoded_once_with_any_marks():
    """Words that come once in each batch, with other marks each time, reach the tokenizer once with a space and once without."""
    import random

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.model, self.normalizer, self.n = tokenizer, self, None, 0
            self.own = tokenizer.model

        def tokenize(self, part):
            self.n += 1
            return self.own.tokenize(part)

        def encode_batch_fast(self, parts, **options):
            self.n += len(parts)
            return self.tokenizer.encode_batch_fast(parts, **options)

    rng = random.Random(10)
    words = sorted({"".join(rng.choices("aeioutnshlñé", k=rng.randint(6, 12))) for _ in range(5000)})
    kept = pieces.Encoder(P.path("byte_bpe_50k.json"))
    kept.tokens = pieces.Tokens(P.path("byte_bpe_50k.json"))
    whole = kept.tokens._whole
    counting = kept.tokens.tokenizer = Counting(kept.tokens.tokenizer)
    for before, after in ((" ", ""), ("\n", "."), (" ", ",%%%"), (" ", "!!"), ("", "$$$"), ("\n", ""), (" ", ".")):
        listed = [before + w + after for w in words]
        seen = counting.n
        assert kept(listed, [1] * len(listed)) == whole(listed)
        counting.n -= len(listed)  # the comparison's own
        assert counting.n >= seen
    assert counting.n <= 2 * len(words) + 2 * pieces.Tokens.TRIED + 100
