import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.frame import OrderedFrame
from millrace.functions import bytes_ as B
from millrace.functions import randoms
from millrace.functions import text as T
from millrace.functions.digest import MD2, digest

TEXTS = ["", "a", "Größe\nüber\n", "\n", "a\n\nb", "x\r\ny", "𝔘nicode " * 20, None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k long, x string")


def col(df, c):
    return [r[0] for r in df.orderBy("k").select(c).collect()]


def test_md2_of_the_rfc():
    for text, want in [("", "8350e5a3e24c153df2275c9f80692773"), ("abc", "da853b0d3f88d99b30283a69e6ded6bb"), ("12345678901234567890123456789012345678901234567890123456789012345678901234567890", "d5976f79d83d3a0dc9806c3c66f3efd8")]:
        h = MD2()
        for c in text:
            h.update(c.encode())
        assert h.hexdigest() == want


@pytest.mark.parametrize("algorithm", ["md5", "sha1", "sha256", "sha384", "sha512"])
def test_digests(spark, texts, algorithm):
    assert col(texts, digest(F.col("x"), algorithm)) == [None if t is None else hashlib.new(algorithm, t.encode()).hexdigest() for t in TEXTS]
    whole = OrderedFrame.of(texts, "k").digest(F.col("x"), algorithm).first()[0]
    assert whole == hashlib.new(algorithm, "".join(t or "" for t in TEXTS).encode()).hexdigest()


def test_md2_column(texts):
    assert col(texts, digest(F.col("x"), "md2"))[0] == "8350e5a3e24c153df2275c9f80692773"


def test_lines(texts):
    want = [None if t is None else (t[:-1] if t.endswith("\n") else t).split("\n") if t else [] for t in TEXTS]
    assert col(texts, T.lines(F.col("x"))) == want


def test_charsets(spark, texts):
    assert col(texts, T.utf8_decode(T.utf8_encode(F.col("x")))) == TEXTS
    for name in ("ISO-8859-15", "UTF-16LE"):
        df = spark.createDataFrame([(0, "Größe €")], "k long, x string")
        assert col(df, T.decode(T.encode(F.col("x"), name), name)) == ["Größe €"]
    bad = spark.createDataFrame([(0, b"a\xffb")], "k long, x binary")
    assert col(bad, T.decode(F.col("x"), "UTF-8", "replace")) == ["a�b"]
    with pytest.raises(PySparkException):
        col(bad, T.utf8_decode(F.col("x")))


def test_chunks_join_before_decoding(spark):
    data = "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich".encode()
    rng, parts, at = random.Random(2), [], 0
    while at < len(data):
        n = rng.randint(0, 5)
        parts.append(data[at : at + n])
        at += n
    f = OrderedFrame.of(spark.createDataFrame(list(enumerate(parts)), "k long, x binary"), "k")
    whole = f.fold_with(lambda acc, r: acc + bytes(r[0]), b"", ["x"], "binary")
    assert whole.select(T.utf8_decode(F.col("folded"))).first()[0] == data.decode()


def test_bytes(spark):
    data = [b"", b"\x00", b"ab", bytes(range(250, 256)) + b"xyz", b"\x12\x34\x23\x41"]
    df = spark.createDataFrame(list(enumerate(data)), "k long, x binary")
    x = F.col("x")
    get = lambda c: [None if v is None else bytes(v) if isinstance(v, bytearray | bytes) else v for v in col(df, c)]
    signed = lambda v: v - 256 if v > 127 else v
    assert get(B.size(x)) == [len(d) for d in data]
    assert get(B.take(x, 2)) == [d[:2] for d in data] and get(B.drop(x, 2)) == [d[2:] for d in data]
    assert get(B.take_right(x, 2)) == [d[-2:] for d in data] and get(B.drop_right(x, 2)) == [d[:-2] for d in data]
    assert get(B.slice_(x, 1, 4)) == [d[1:4] for d in data]
    assert get(B.lift(x, 1)) == [signed(d[1]) if len(d) > 1 else None for d in data]
    assert get(B.index_of_slice(x, F.lit(b"\x34\x23"))) == [d.find(b"\x34\x23") for d in data]
    assert get(B.index_of_slice(x, F.lit(b"\x23\x42"))) == [-1] * 5
    assert get(B.contains_slice(x, F.lit(b"b"))) == [b"b" in d for d in data]
    assert get(B.starts_with(x, F.lit(b"a"))) == [d[:1] == b"a" for d in data] and get(B.ends_with(x, F.lit(b"z"))) == [d[-1:] == b"z" for d in data]
    assert get(B.reverse(x)) == [d[::-1] for d in data]
    assert get(B.patch(x, 1, F.lit(b"--"), 1)) == [d[:1] + b"--" + d[2:] for d in data]
    assert get(B.append(B.prepend(1, x), 2)) == [b"\x01" + d + b"\x02" for d in data]
    assert get(B.insert(x, 1, F.lit(b"!"))) == [d[:1] + b"!" + d[1:] for d in data]
    assert get(B.update(F.concat(x, F.lit(b"qq")), 1, 7)) == [(d + b"qq")[:1] + b"\x07" + (d + b"qq")[2:] for d in data]
    assert get(B.splice(F.concat(x, F.lit(b"qq")), 0, F.lit(b"ZZ"))) == [b"ZZ" + (d + b"qq")[2:] for d in data]
    assert get(B.pad_left(x, 9)) == [d.rjust(9, b"\0") for d in data] and get(B.pad_right(x, 9)) == [d.ljust(9, b"\0") for d in data]
    assert get(B.to_array(x)) == [[signed(v) for v in d] for d in data]
    assert get(B.map_(x, lambda v: v + 1)) == [bytes((v + 1) % 256 for v in d) for d in data]
    assert get(B.fold_left(x, F.lit(0).cast("long"), lambda a, v: a * 2 + v))[2] == 97 * 2 + 98
    assert get(B.fold_right(x, F.lit(0).cast("long"), lambda v, a: a * 2 + v))[2] == 98 * 2 + 97
    assert get(B.fill(B.size(x), 7)) == [b"\x07" * len(d) for d in data]
    assert get(B.concat(B.of(1, 255), B.empty())) == [b"\x01\xff"] * 5
    for bad in (B.head(x), B.tail(x), B.pad_left(x, 3), B.byte_at(x, 5)):
        with pytest.raises(PySparkException):
            col(df, bad)


class Plain:
    """The generator, a value at a time."""

    def __init__(self, seed0, seed1):
        self.a, self.b = seed0 % 2**64, seed1 % 2**64

    def long(self):
        signed = lambda v: v - 2**64 if v >= 2**63 else v
        x, y = self.a, self.b
        x ^= x << 23 & (2**64 - 1)
        self.a, self.b = y, (x ^ y ^ signed(x) >> 17 ^ signed(y) >> 26) % 2**64
        return signed((self.b + y) % 2**64)

    def int(self, bound):
        low = self.long() % 2**32
        return low & bound - 1 if not bound & bound - 1 else (low >> 1) % bound


@pytest.mark.parametrize("start,n", [(0, 1), (0, 1000), (7, 600), (10**6, 300), (12345, 1)])
def test_values_from_any_place(start, n):
    plain = Plain(5, -9)
    for _ in range(start):
        plain.long()
    assert randoms.longs_from(5, -9, start, n).tolist() == [plain.long() for _ in range(n)]


def test_randoms(spark, small_chunks):
    """Beside the rows of many chunks, as one loop makes them."""
    from millrace.frame import OrderedFrame

    rows = spark.range(40).select((F.lit(100) - F.col("id")).alias("k"), F.array(*(F.lit(i) for i in range(9))).alias("xs")).repartition(5)
    f = randoms.drawn(OrderedFrame.of(rows, "k"), 1, 2, "r", per_row=9)
    r, one = F.col("r"), F.col("r")[0]
    made = f.df.select("k", r, randoms.next_int(one).alias("i"), randoms.next_int(one, 10).alias("ten"), randoms.next_int(one, 16).alias("sixteen"), randoms.next_long(one, 10**12).alias("l"), randoms.next_double(one).alias("d"), randoms.next_float(one).alias("f"), randoms.next_boolean(one).alias("b"), randoms.next_bytes(r, 13).alias("y"), randoms.pick(F.col("xs"), one).alias("p"), randoms.shuffled(F.col("xs"), r).alias("s"), randoms.alphanumeric(r).alias("a"), randoms.decide_pow2(one, 3).alias("e"), randoms.decide(one, 0.25).alias("c"))
    plain = Plain(1, 2)
    for row in made.orderBy("k").collect():
        own = [plain.long() for _ in range(9)]
        assert row.r == own
        again = lambda i: type("One", (Plain,), {"long": lambda self: own[i]})(0, 1)  # noqa: B023, E731
        assert row.i == (own[0] + 2**31) % 2**32 - 2**31 and row.ten == again(0).int(10) == row.ten and row.sixteen == again(0).int(16)
        assert row.l == (own[0] % 2**64 >> 1) % 10**12 and row.d == own[0] % 2**53 / 2**53 and row.f == own[0] % 2**24 / 2**24 and row.b == (own[0] % 2 == 1)
        assert bytes(row.y) == (own[1] % 2**64).to_bytes(8, "big")[3:] + (own[0] % 2**64).to_bytes(8, "big")
        assert row.p == again(0).int(9) and row.e == (own[0] % 8 == 0) and row.c == (row.d < 0.25)
        xs = list(range(9))
        for n, i in enumerate(range(8, 0, -1)):
            j = again(n).int(i + 1)
            xs[i], xs[j] = xs[j], xs[i]
        assert row.s == xs
        assert row.a == "".join(randoms.CHARACTERS[again(i).int(62)] for i in range(9))


def test_a_random_order_is_a_permutation(spark):
    from millrace.sources import values

    got = [r.value for r in randoms.in_random_order(values.longs(spark, 0, count=200), 3, 4).sorted().collect()]
    plain = Plain(3, 4)
    assert got == [i for _, i in sorted((plain.long(), i) for i in range(200))] and got != sorted(got)
    with pytest.raises(ValueError):
        randoms.longs_from(0, 0, 0, 3)
