"""Timed operators against plain Python."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.frame import OrderedFrame


def timed(spark, times, by=None):
    rows = [(i, t, by[i] if by else 0) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k long, t long, g long").select("k", F.timestamp_micros("t").alias("ts"), "t", "g")
    return OrderedFrame.of(df, "k", ("g",) if by else ())


def out(f, column):
    return [r[column] for r in f.sorted().collect()]


def times(n, seed=3):
    rng = random.Random(seed)
    t, got = 1000, []
    for _ in range(n):
        t += rng.randint(0, 50)
        got.append(t)
    return got


def test_within(spark, small_chunks):
    ts = times(30)
    f = timed(spark, ts)
    assert out(f.take_within(300, "ts"), "t") == [t for t in ts if t - ts[0] < 300]
    assert out(f.drop_within(300, "ts"), "t") == [t for t in ts if t - ts[0] >= 300]
    assert out(f.take_within(300, "ts", start=1100), "t") == [t for t in ts if t - 1100 < 300]


def test_delay(spark, small_chunks):
    ts = times(40)
    rng = random.Random(1)
    ds = [rng.randint(0, 60) for _ in ts]
    want, last = [], 0
    for t, d in zip(ts, ds, strict=True):
        last = max(t, last) + d
        want.append(last)
    f = timed(spark, ts).with_columns(d=F.get(F.array(*map(F.lit, ds)), F.col("k").cast("int")))
    assert out(f.delay(F.col("d"), "ts"), "emitted") == want


@pytest.mark.parametrize("elements,per,burst", [(1, 20, 1), (3, 100, 4), (2, 7, 1)])
def test_throttle(spark, elements, per, burst):
    """Exact fractions of tokens."""
    from fractions import Fraction

    ts = times(40)
    want, tokens, now = [], Fraction(burst), None
    for t in ts:
        at = t if now is None else max(t, now)
        if now is not None:
            tokens = min(Fraction(burst), tokens + Fraction((at - now) * elements, per))
        wait = max(0, -((tokens - 1) * per // elements)) if tokens < 1 else 0
        tokens += Fraction(wait * elements, per) - 1
        now = at + wait
        want.append(now)
    assert out(timed(spark, ts).throttle(elements, per, "ts", burst), "emitted") == want


def test_throttle_spaces_a_burst(spark):
    assert out(timed(spark, [0] * 6).throttle(1, 10, "ts", burst=2), "emitted") == [0, 0, 10, 20, 30, 40]


def test_timeouts(spark, small_chunks):
    f = timed(spark, [100, 110, 150])
    assert out(f.gaps("ts"), "gap") == [None, 10, 40]
    assert out(f.with_idle_timeout(40, "ts"), "t") == [100, 110, 150]
    for bad in (lambda: f.with_idle_timeout(39, "ts"), lambda: f.with_initial_timeout(9, "ts", 90), lambda: f.with_completion_timeout(49, "ts")):
        with pytest.raises(PySparkException, match="StreamTimeout"):
            bad().df.collect()
    assert f.with_initial_timeout(10, "ts", 90).df.count() == 3
    assert f.with_completion_timeout(50, "ts").df.count() == 3


def test_expand_conflate_sample(spark, small_chunks):
    f = timed(spark, [0, 25, 31])
    assert [(r["t"], r["at"]) for r in f.expand(10, "ts").sorted().collect()] == [(0, 0), (0, 10), (0, 20), (25, 25), (31, 31)]
    assert out(f.expand_with(10, "ts", lambda n: n * 2), "extrapolated") == [0, 2, 4, 0, 0]
    assert out(f.conflate(30, "ts", F.col("t")), "values") == [[0, 25], [31]]
    assert out(f.conflate_with_seed(30, "ts", total=F.sum("t")), "total") == [25, 31]
    assert out(f.sample(30, "ts"), "t") == [25, 31]


def test_grouped_within(spark):
    f = timed(spark, [0, 5, 9, 10, 11, 12, 40], by=[0] * 7)
    assert out(f.grouped_within(3, 10, "ts", "t"), "group") == [[0, 5, 9], [10, 11, 12], [40]]
    assert out(timed(spark, [0, 5, 10]).grouped_within(9, 10, "ts", "t"), "group") == [[0, 5], [10]]


def test_buffer_dropping(spark):
    ts = [0, 1, 2, 3, 4, 150]  # two times at which the buffer is emptied
    kept = lambda strategy, size=2: out(timed(spark, ts).buffer_dropping(size, "ts", 100, strategy), "t")
    assert kept("DropHead") == [3, 4, 150]
    assert kept("DropNew") == [0, 1, 150]
    assert kept("DropTail") == [0, 4, 150]
    assert kept("DropBuffer") == [4, 150]
    assert kept("DropBuffer", 5) == kept("Fail", 5) == ts
    with pytest.raises(PySparkException, match="BufferOverflow"):
        kept("Fail")
    with pytest.raises(ValueError):
        kept("DropAll")


def test_expand_from_a_zero(spark):
    from millrace.frame import OrderedFrame

    df = spark.createDataFrame([(1, 10_000_000, 5), (2, 13_500_000, 7), (3, 13_500_000, 8)], "k long, t long, x long").select("k", F.timestamp_micros("t").alias("ts"), "x")
    more = lambda f: [(r["at"] // 1_000_000, r.extrapolated) for r in f.expand_from(0, 1_000_000, "ts", 7_000_000, F.col("x"), lambda v, n: v * 100 + n).sorted().collect()]
    f = OrderedFrame.of(df, "k")
    assert more(f) == [(7, 0), (8, 1), (9, 2), (10, 500), (11, 501), (12, 502), (13, 503), (13, 700), (13, 800)]
    assert more(f.drop_all()) == [(7, 0)]
    assert more(f.drop(1)) == [*((7 + i, i) for i in range(7)), (13, 700), (13, 800)]
