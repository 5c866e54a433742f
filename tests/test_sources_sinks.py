import random
from concurrent.futures import Future

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.frame import OrderedFrame
from millrace.sinks import NoSuchElement, StreamLimitExceeded, capture_result, contramap, drop_result, lazy_drain, map_result, write_file
from millrace.sources import files, values


def out(f):
    return [r["value"] for r in f.sorted().collect()]


def done(x):
    f = Future()
    f.set_result(x)
    return f


def test_values(spark):
    assert out(values.of(spark, "int", 3, 1, 2)) == [3, 1, 2]
    assert out(values.empty(spark, "int")) == [] == out(values.empty_from(spark, done(None), "int"))
    assert out(values.ints(spark, 5, -2, count=3)) == [5, 3, 1]
    assert out(values.longs(spark, 1 << 40, count=2)) == [1 << 40, (1 << 40) + 1]
    assert out(values.doubles(spark, 0.5, 0.25, count=3)) == [0.5, 0.75, 1.0]
    assert out(values.repeat(spark, "a", count=3)) == ["a"] * 3
    assert len(set(out(values.continually(spark, F.rand(1), count=5)))) == 5
    assert out(values.from_option(spark, None, "int")) == []
    assert out(values.from_future(spark, done(7), "int")) == [7]
    assert out(values.iterate(spark, 1, lambda x: x * 2, "long", count=5)) == [1, 2, 4, 8, 16]
    assert out(values.iterate(spark, 1, lambda x: x * 2, "long", count=0)) == []
    assert [str(r["at"])[-8:] for r in values.tick(spark, 1, "2020-01-01 00:00:00", "10 seconds", count=4, elements=2).sorted().collect()] == ["00:00:00", "00:00:00", "00:00:10", "00:00:10"]


def test_unfold_fibonacci(spark):
    """The last element with and without the end that follows it."""
    final = values.unfold(spark, (0, 1), lambda s: (s[0], (s[1], s[0] + s[1])) if s[1] <= 8 else (s[0], None), "int")
    assert out(final) == [0, 1, 1, 2, 3, 5, 8]
    ends = values.unfold(spark, (0, 1), lambda s: (s[0], (s[1], s[0] + s[1])) if s[0] <= 8 else None, "int")
    assert out(ends) == [0, 1, 1, 2, 3, 5, 8]
    assert out(values.unfold_async(spark, 0, lambda s: done((s, s + 1) if s < 3 else None), "int")) == [0, 1, 2]
    with pytest.raises(PySparkException):
        values.unfold(spark, 0, lambda s: (s, s), "int", most=10).df.collect()


def test_errors(spark):
    with pytest.raises(OSError):
        values.failing(spark, OSError("no"), "int")
    with pytest.raises(PySparkException, match="no luck"):
        values.failing(spark, OSError("no luck"), "int", eager=False).df.collect()
    with pytest.raises(OSError):
        values.from_try(spark, OSError(), "int")


def test_push(spark):
    p = values.Push(spark, "int", most=3)
    assert p.offer(1) and p.offer_many([2, 3, 4]) == 2 and not p.accepts_next and p.queue_size == 3
    with pytest.raises(RuntimeError):
        p.frame()
    p.complete()
    assert out(p.frame()) == [1, 2, 3] and not p.offer(4)
    q = values.Push(spark, "int")
    q.error_complete(OSError())
    with pytest.raises(OSError):
        q.frame()


def test_anything_is_a_source(spark):
    made = []
    lazy = values.lazy_start(lambda: made.append(1) or values.one(spark, 5, "int"))
    assert out(lazy()) == [5] and out(values.source(spark, lazy, "int")) == [5] and made == [1]
    assert out(values.source(spark, [1, 2], "int")) == [1, 2]
    assert out(values.source(spark, b"\x01\xff", "tinyint")) == [1, -1]
    assert out(values.source(spark, None, "int")) == []
    assert out(values.source(spark, "ab", "string")) == ["ab"]


def test_file_in_chunks(spark, tmp_path):
    data = b"".join(c.encode() * 1000 for c in "abcdef")
    write_file(str(tmp_path / "x.bin"), data)
    chunks = out(files.from_file(spark, str(tmp_path / "x.bin"), 512))
    assert b"".join(map(bytes, chunks)) == data and [len(c) for c in chunks] == [512] * 11 + [368]
    assert files.read_file(str(tmp_path / "x.bin")) == data
    write_file(str(tmp_path / "none.bin"), b"")
    assert out(files.from_file(spark, str(tmp_path / "none.bin"))) == []
    with pytest.raises(PySparkException):
        files.from_file(spark, str(tmp_path / "missing")).df.collect()


def test_fahrenheit(spark, tmp_path):
    """Lines of a file, converted, to a file."""
    write_file(str(tmp_path / "f.txt"), b"// header\n50.8\n80.2\n63.0\n-14\n\n32\n-459.67\n// 451\n451")
    f = files.from_file_lines(spark, str(tmp_path / "f.txt"))
    f = f.filter(~F.col("value").startswith("//") & (F.trim("value") != ""))
    f = f.map(value=F.format_number((F.col("value").cast("double") - 32) * 5 / 9, 2))
    lines = f.intersperse("value", F.lit("\n"))
    assert lines.to_file(str(tmp_path / "c.txt"), F.col("value")) == len("10.44\n26.78\n17.22\n-25.56\n0.00\n-273.15\n232.78")
    assert (tmp_path / "c.txt").read_text().split("\n") == ["10.44", "26.78", "17.22", "-25.56", "0.00", "-273.15", "232.78"]


def test_sinks(spark, tmp_path):
    rows = list(range(10))
    random.Random(1).shuffle(rows)
    f = OrderedFrame.of(spark.createDataFrame([(i, i) for i in rows], "k long, value long"), "k")
    assert [r.value for r in f.seq(10)] == list(range(10))
    with pytest.raises(StreamLimitExceeded):
        f.seq(9)
    assert f.head().value == 0 and f.last_row().value == 9 and [r.value for r in f.first_rows(3)] == [0, 1, 2]
    none = f.drop_all()
    assert none.head_option() is None and none.last_option() is None
    for call in (none.head, none.last_row):
        with pytest.raises(NoSuchElement):
            call()
    seen = []
    f.foreach(lambda r: seen.append(r.value))
    assert seen == list(range(10))
    total = spark.sparkContext.accumulator(0)
    f.parallel_foreach(3, lambda r: total.add(r.value))
    assert total.value == 45
    f.cancelling()
    assert lazy_drain(lambda: lambda g: g.df.count())(f) == 10
    f.map(value=F.col("k").cast("string")).to_files(str(tmp_path / "out"), "value")
    assert sorted(int(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()) == list(range(10))


def test_results_of_drains(spark):
    f, kept = values.of(spark, "int", 1, 2, 3), []
    count = lambda g: g.df.count()
    assert map_result(count, lambda n: n + 1)(f) == 4 and drop_result(count)(f) is None
    assert capture_result(count, kept.append)(f) == 3 and kept == [3]
    assert contramap(count, lambda g: g.take(2))(f) == 2
