"""Errors of functions as data."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.frame import OrderedFrame

BAD = 12


def risky(r):
    (x,) = r
    if x == BAD:
        raise KeyError("bad")
    return 100 // (x - 20)


def frame(spark, xs, by=()):
    rows = [(i * 2, i % 2, x) for i, x in enumerate(xs)]
    random.Random(3).shuffle(rows)
    return OrderedFrame.of(spark.createDataFrame(rows, "k long, key long, x long").repartition(4), "k", by)


def spare(spark, values):
    return OrderedFrame.of(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, value long"), "k")


def out(f):
    return [r.value for r in f.sorted().collect()]


CLEAN, DIVIDES, MISSES = [1, 2, 3], [1, 2, 20, 3, 20, 12], [5, 12, 20, 7]


def test_rows_are_tried(spark):
    f = frame(spark, DIVIDES).try_map(risky, ["x"], "long")
    got = f.sorted().collect()
    assert [r.ok for r in got] == [True, True, False, True, False, False]
    assert [r.value for r in got if r.ok] == [100 // (x - 20) for x in (1, 2, 3)]
    assert [r.error_type for r in got if not r.ok] == ["ZeroDivisionError", "ZeroDivisionError", "KeyError"]
    with pytest.raises(ValueError):
        frame(spark, CLEAN).try_map(risky, ["x"], "long", name="k")


def test_recover(spark):
    tried = lambda xs: frame(spark, xs).try_map(risky, ["x"], "long")
    value = lambda xs: [100 // (x - 20) for x in xs]
    assert out(tried(CLEAN).recover_raised(spare(spark, [0]))) == value(CLEAN)
    assert out(tried(DIVIDES).recover_raised(spare(spark, [0, -1]))) == [*value([1, 2]), 0, -1]
    assert out(tried(DIVIDES).recover_raised(spare(spark, [0]), errors=("ZeroDivisionError",))) == [*value([1, 2]), 0]
    assert out(tried([20]).recover_raised(spare(spark, [7]))) == [7]
    assert out(tried([]).recover_raised(spare(spark, [7]))) == []
    # a fallback that fails too, and the next one
    again = tried(DIVIDES).recover_raised(tried(MISSES), spare(spark, [9]))
    assert out(again) == [*value([1, 2]), *value([5]), 9]
    assert out(tried(CLEAN).recover_raised(tried(MISSES), spare(spark, [9]))) == value(CLEAN)


def test_errors_that_nobody_handles(spark):
    tried = frame(spark, MISSES).try_map(risky, ["x"], "long")
    for f in (tried.recover_raised(), tried.recover_raised(spare(spark, [0]), errors=("ZeroDivisionError",))):
        with pytest.raises(PySparkException, match="KeyError"):
            f.df.collect()
    # an error after the one that was handled isn't seen
    assert out(frame(spark, DIVIDES).try_map(risky, ["x"], "long").recover_raised(spare(spark, [0]), errors=("ZeroDivisionError",)))[-1] == 0


def test_to_try(spark):
    got = frame(spark, DIVIDES).try_map(risky, ["x"], "long").raised_to_try().sorted().collect()
    assert [(r.result.ok, r.result.error_type) for r in got] == [(True, None), (True, None), (False, "ZeroDivisionError")]
    keyed = frame(spark, [1, 2, 20, 3, 5, 12, 6, 7], "key").try_map(risky, ["x"], "long").raised_to_try()
    found = {}
    for r in keyed.sorted().collect():
        found.setdefault(r.key, []).append(r.result.ok)
    assert found == {0: [True, False], 1: [True, True, False]}


def test_each_row_is_tried_once(spark, tmp_path):
    def touch(r):
        with open(tmp_path / "seen", "a") as f:
            f.write("x")
        return r[0]

    f = frame(spark, list(range(30))).try_map(touch, ["x"], "long")
    assert len(out(f.recover_raised(spare(spark, [0])))) == 30
    assert f.df.agg(F.count("*")).first()[0] == 30
    assert len((tmp_path / "seen").read_text()) == 30
