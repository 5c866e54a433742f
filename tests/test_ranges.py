"""Files as ranges of bytes, and one file written by many tasks."""

import io
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace import positions
from millrace.frame import OrderedFrame
from millrace.sources import files, ranges, values

SF = "/root/testdata/sf0.001"


def all_of(data, kind, piece, step):
    return [x for at in range(0, len(data), step) for x in ranges.pieces(io.BytesIO(data), at, min(len(data), at + step), kind, piece)]


@pytest.mark.parametrize("seed", range(40))
def test_pieces_of_any_ranges(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "\n", "\n\n", "ü", "€", "𝔘", "word "]) for _ in range(rng.choice([0, 1, 5, 60])))
    data = text.encode()
    for step in (1, 2, 3, 7, 64, 1000):
        for piece in (1, 2, 5, 100):
            lines = all_of(data, "lines", piece, step)
            want = text.split("\n")
            want = [x.encode() for x in (want[:-1] if want[-1] == "" else want)]
            assert [v for _, v in lines] == want
            assert all(data[p : p + len(v)] == v and (p == 0 or data[p - 1 : p] == b"\n") for p, v in lines)
            chars = all_of(data, "text", piece, step)
            assert "".join(v.decode() for _, v in chars) == text and [p for p, _ in chars] == sorted(p for p, _ in chars)
            if step % piece == 0:
                assert all_of(data, "bytes", piece, step) == [(i, data[i : i + piece]) for i in range(0, len(data), piece)]


def test_lines_of_a_table_in_ranges_of_1_kb(spark):
    """The lines of a binary file are as good as any, whatever they hold."""
    path = f"{SF}/orders.parquet"
    with open(path, "rb") as f:
        data = f.read()
    df = ranges.read_ranges(spark, path, "lines", 100, 1024)
    assert df.rdd.getNumPartitions() == -(-len(data) // 1024)
    lines = data.split(b"\n")
    assert [bytes(r.value) for r in df.orderBy("place").collect()] == (lines[:-1] if lines[-1] == b"" else lines)
    chunks = files.from_file(spark, path, 100, 1000).sorted().collect()
    assert b"".join(bytes(r.value) for r in chunks) == data and [r.pos for r in chunks] == list(range(len(chunks)))


def test_folders_and_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_bytes("eins\nzwei ü€\n".encode())
    (tmp_path / "in" / "a.txt").write_bytes(b"no end")
    (tmp_path / "in" / "_hidden").write_bytes(b"x")
    (tmp_path / "in" / "c.txt").write_bytes(b"")
    f = files.from_file_lines(spark, str(tmp_path / "in"), range_bytes=4)
    assert [r.value for r in f.sorted().collect()] == ["no end", "eins", "zwei ü€"]
    t = files.from_file_text(spark, str(tmp_path / "in" / "b.txt"), 3, range_bytes=5)
    assert "".join(r.value for r in t.sorted().collect()) == "eins\nzwei ü€\n"
    (tmp_path / "bad").write_bytes(b"ok\n\xff\xfe\n")
    assert [r.value for r in files.from_file_lines(spark, str(tmp_path / "bad")).sorted().collect()] == ["ok", "��"]
    with pytest.raises(PySparkException):
        files.from_file_lines(spark, str(tmp_path / "bad"), on_malformed="report").df.collect()
    with pytest.raises(ValueError):
        ranges.read_ranges(spark, str(tmp_path / "bad"), "words")


@pytest.mark.parametrize("chunk", [100, 1_000_000])
def test_one_file_by_many_tasks(spark, monkeypatch, tmp_path, chunk):
    monkeypatch.setattr(positions, "CHUNK_ROWS", chunk)
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", lambda *a, **k: pytest.fail("rows came to the driver"))
    f = OrderedFrame.of(spark.read.parquet(f"{SF}/events.parquet").repartition(5), "event_id")
    line = F.when(F.col("event_id") % 50 != 7, F.concat_ws("|", "event_id", "event_type", F.lit("ü\n")))
    want = b"".join(f"{r.event_id}|{r.event_type}|ü\n".encode() for r in f.df.orderBy("event_id").collect() if r.event_id % 50 != 7)
    path = str(tmp_path / "events.txt")
    assert f.to_file(path, line) == len(want)
    with open(path, "rb") as x:
        assert x.read() == want
    assert f.take(3).to_file(path, F.lit("end\n"), append=True) == 12
    with open(path, "rb") as x:
        assert x.read() == want + b"end\n" * 3
    assert os.listdir(tmp_path) == ["events.txt"]
    assert f.drop_all().to_file(str(tmp_path / "none"), line) == 0 and os.path.getsize(tmp_path / "none") == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    f = values.longs(spark, 0, count=100)
    fails = F.when(F.col("value") == 77, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("string")
    with pytest.raises(PySparkException):
        f.to_file(str(tmp_path / "x"), fails)
    df = spark.createDataFrame([(0, b"abc"), (5, b"de")], "_at long, v binary")
    with pytest.raises(PySparkException):  # a hole
        ranges.write_places(df, str(tmp_path / "x"))
    assert os.listdir(tmp_path) == []
    (tmp_path / "y").write_bytes(b"old")
    with pytest.raises(PySparkException):
        ranges.write_places(df, str(tmp_path / "y"), append=True)
    assert (tmp_path / "y").read_bytes() == b"old"


def test_streams_one_after_the_other(spark, tmp_path):
    f = values.longs(spark, 0, count=10).inject_round_robin(3)
    assert f.to_file(str(tmp_path / "x"), F.col("value").cast("string")) == 10
    assert (tmp_path / "x").read_bytes() == b"0369147258"


def test_many_small_ranges_share_tasks(spark, monkeypatch, tmp_path):
    """Ranges of 16 bytes of a long file: no task for each, and the same pieces."""
    data = "".join(f"{i} ü€\n" for i in range(3000)).encode()
    (tmp_path / "x").write_bytes(data)
    n = -(-len(data) // 16)
    for kind in ranges.KINDS:
        df = ranges.read_ranges(spark, str(tmp_path / "x"), kind, 5, 16)
        assert df.rdd.getNumPartitions() == ranges.MOST_SMALL < n
        step = 20 if kind == "bytes" else 16  # a multiple of a chunk
        assert [(r.place, bytes(r.value)) for r in df.orderBy("place").collect()] == all_of(data, kind, 5, step)
    monkeypatch.setattr(ranges, "RANGE_BYTES", 32)
    assert len(ranges.together([("x", i, i + 16) for i in range(0, 16_000, 16)], "text")) == 500
    assert ranges.together([("x", 0, 4), ("x", 4, 8), ("y", 0, 4)], "lines") == [[("x", 0, 4)], [("x", 4, 8)], [("y", 0, 4)]]
