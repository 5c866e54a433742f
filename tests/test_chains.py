"""Chains of positional operators, and streams of streams of streams, against plain Python lists."""

import functools
import itertools

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.frame import OrderedFrame
from millrace.sources import values

N = 17
#: Operators on a frame with a column v, and the same on a list.
STEPS = {
    "drop": (lambda f: f.drop(2), lambda x: x[2:]),
    "drop_last": (lambda f: f.drop_last(2), lambda x: x[:-2]),
    "take": (lambda f: f.take(9), lambda x: x[:9]),
    "take_last": (lambda f: f.take_last(8), lambda x: x[-8:]),
    "slice": (lambda f: f.slice(1, 10), lambda x: x[1:11]),
    "slice_every": (lambda f: f.slice_every(1, 2), lambda x: [y for i, y in enumerate(x) if i % 3]),
    "take_every_nth": (lambda f: f.take_every_nth(2), lambda x: x[1::2]),
    "deduplicate": (lambda f: f.deduplicate("v"), lambda x: [k for k, _ in itertools.groupby(x)]),
    "with_limit": (lambda f: f.with_limit(10 * N), lambda x: x),
    "multiply": (lambda f: f.multiply(2).take_every_nth(2), lambda x: x),
    "split": (lambda f: f.split_when(F.col("v") % 4 == 0).take(3).flatten_concat(), lambda x: [y for g in cut(x, lambda v: v % 4 == 0) for y in g[:3]]),
    "concat": (lambda f: f.concat(f).drop(1), lambda x: [*x, *x][1:]),
    "gaps": (lambda f: f.with_columns(ts=F.timestamp_micros("v")).gaps("ts"), lambda x: x),
}


def cut(xs, starts):
    out = []
    for i, x in enumerate(xs):
        if i == 0 or starts(x):
            out.append([])
        out[-1].append(x)
    return out


def sources(spark):
    table = OrderedFrame.of(spark.createDataFrame([(i * 7 % N, N - i) for i in range(N)], "k long, pos long"), "k")
    of_k = {i * 7 % N: N - i for i in range(N)}
    ones = values.longs(spark, 0, count=N)
    return {
        "source": (ones.with_columns(v=F.floor(F.col("value") / 2)), [i // 2 for i in range(N)]),
        "zip": (ones.zip(values.longs(spark, 100, count=N + 3)).with_columns(v=F.col("_1.value") + F.col("_2.value")), [100 + 2 * i for i in range(N)]),
        "scan": (ones.scan("sum", F.col("value"), 0, "v").drop(1), list(itertools.accumulate(range(N)))),
        "pos of its own": (table.with_columns(v=F.col("pos")), [of_k[k] for k in range(N)]),
    }


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("source", ["source", "zip", "scan", "pos of its own"])
def test_all_pairs(spark, monkeypatch, source, many):
    from millrace import positions

    if many:
        monkeypatch.setattr(positions, "CHUNK_ROWS", 6)
    first, xs = sources(spark)[source]
    first = first.settled()
    names = list(STEPS) if source == "source" and not many else ["drop", "slice", "deduplicate", "split", "multiply"]
    for a in names:
        ways, want = [], {}
        one = STEPS[a][0](first)
        for n, b in enumerate(names):
            if a == b == "concat":
                continue
            f = STEPS[b][0](one)
            ways.append(f.df.select(F.lit(n).alias("n"), F.struct(*f.order).cast("string").alias("text"), F.array(*(F.col(c).cast("long") for c in f.order)).alias("place"), F.col("v").cast("long").alias("v")))
            want[n] = STEPS[b][1](STEPS[a][1](xs))
        got = {n: [] for n in want}
        for r in functools.reduce(DataFrame.unionByName, ways).orderBy("n", "place").collect():
            got[r.n].append(r.v)
        assert got == want, a


def test_a_chain_is_counted_once(spark, monkeypatch):
    counted = []
    count = type(spark.range(1)).count
    monkeypatch.setattr(type(spark.range(1)), "count", lambda self: counted.append(1) or count(self))
    f = values.longs(spark, 0, count=50).drop(2).slice(1, 40).take_every_nth(3).drop(1)
    assert [r.value for r in f.sorted().collect()] == list(range(3, 43))[2::3][1:]
    assert len(counted) == 1
    f.multiply(2).drop(1)
    assert len(counted) == 2


def test_names_that_are_taken(spark):
    f = OrderedFrame.of(spark.createDataFrame([(1, 2, 3)], "k long, _pos long, turn long"), "k")
    with pytest.raises(ValueError):
        f.drop(1)
    with pytest.raises(ValueError):
        values.longs(spark, 0, count=3).with_columns(turn=F.lit(1)).interleave(values.longs(spark, 0, count=3).with_columns(turn=F.lit(1)))
    with pytest.raises(ValueError):
        OrderedFrame.of(f.df, ("k", "k"))
    twice = f.df.select("k").withColumn("a", F.array(F.lit(1), F.lit(2)))
    nested = OrderedFrame.of(twice, "k").flat_map(F.col("a"), "x").flat_map(F.array("x", "x"), "y")
    assert nested.order == ("k", "idx", "idx_2") and nested.df.count() == 4
    a, b = (values.longs(spark, i, count=2) for i in (0, 10))
    whole = a.concat(b).concat(b.concat(a))
    assert whole.order == ("src_2", "src", "pos") and [r.value for r in whole.sorted().collect()] == [0, 1, 10, 11, 10, 11, 0, 1]


def paths(f, value="value"):
    """Nested lists of the values of a frame's sub-streams, by path."""
    got = {}
    for r in f.df.orderBy(*f.by, *f.order).collect():
        got.setdefault(tuple(r[c] for c in f.by), []).append(r[value])
    return [got[k] for k in sorted(got)]


@pytest.mark.parametrize("chunk", [6, 1_000_000])
def test_three_levels(spark, monkeypatch, chunk):
    from millrace import positions

    monkeypatch.setattr(positions, "CHUNK_ROWS", chunk)
    f = values.longs(spark, 0, count=53).inject_sequential(20).inject_sequential(6).inject_sequential(2)
    assert f.by == ("group_id", "group_id_2", "group_id_3") and f.levels == (1, 1, 1)
    want = []
    for a in range(0, 53, 20):
        outer = list(range(53))[a : a + 20]
        for b in range(0, len(outer), 6):
            middle = outer[b : b + 6]
            want += [middle[c : c + 2] for c in range(0, len(middle), 2)]
    assert paths(f) == want
    one = f.flatten_concat()
    assert one.by == ("group_id", "group_id_2") and one.order == ("group_id_3", "pos")
    whole = one.flatten_concat().flatten_concat()
    assert whole.by == () and [r.value for r in whole.sorted().collect()] == list(range(53))
    # folds of folds
    sums = f.fold_streams("sum", F.col("value"), 0, "s").fold_streams("max", F.col("s"), 0, "m").fold_streams("sum", F.col("m"), 0, "t")
    assert sums.by == () and sums.order == ("group_id",)
    most = []
    for a in range(0, 53, 20):
        outer, best = list(range(53))[a : a + 20], []
        for b in range(0, len(outer), 6):
            middle = outer[b : b + 6]
            best.append(max(sum(middle[c : c + 2]) for c in range(0, len(middle), 2)))
        most.append(sum(best))
    assert [r.t for r in sums.sorted().collect()] == most
    # what a sub-stream's consumer takes and drops
    assert paths(f.drop(1).flatten_concat().take(2)) == [g for g in ([x[1] for x in g if len(x) > 1][:2] for g in nested(53)) if g]  # a stream without rows isn't there


def nested(n):
    out = []
    for a in range(0, n, 20):
        outer = list(range(n))[a : a + 20]
        out += [[outer[b : b + 6][c : c + 2] for c in range(0, len(outer[b : b + 6]), 2)] for b in range(0, len(outer), 6)]
    return out


def test_cuts_within_cuts(spark):
    f = values.longs(spark, 0, count=12)
    assert paths(f.inject_sequential(6).inject_sequential(2)) == [[0, 1], [2, 3], [4, 5], [6, 7], [8, 9], [10, 11]]
    assert paths(f.split_when(F.col("value") % 6 == 0).split_after(F.col("value") % 3 == 1)) == [[0, 1], [2, 3, 4], [5], [6, 7], [8, 9, 10], [11]]
    command = F.when(F.col("value") % 4 == 3, "DropComplete")
    assert paths(f.split(command).split(F.when(F.col("value") % 4 == 1, "EmitComplete"))) == [[0, 1], [2], [4, 5], [6], [8, 9], [10]]
    assert paths(f.inject_round_robin(2).inject_round_robin(3)) == [[0, 6], [2, 8], [4, 10], [1, 7], [3, 9], [5, 11]]
    assert paths(f.inject_round_robin(3).inject_broadcast(2)) == [[0, 3, 6, 9]] * 2 + [[1, 4, 7, 10]] * 2 + [[2, 5, 8, 11]] * 2
    any_ = paths(f.inject_to_any(2).inject_to_any(2))
    assert sorted(itertools.chain(*any_)) == list(range(12)) and len(any_) > 2
    assert paths(f.inject_sequential(6).grouped(4, F.col("value"), name="value")) == [[[0, 1, 2, 3], [4, 5]], [[6, 7, 8, 9], [10, 11]]]
    keyed = f.with_columns(k=F.col("value") % 2).inject_sequential(6).group_by(2, "k")
    assert paths(keyed) == [[0, 2, 4], [1, 3, 5], [6, 8, 10], [7, 9, 11]]
    with pytest.raises(Exception):
        f.with_columns(k=F.col("value") % 3).inject_sequential(6).group_by(2, "k").df.collect()


def test_flatten_within_streams(spark):
    f = values.longs(spark, 0, count=14).inject_sequential(8).inject_round_robin(3)
    assert paths(f.flatten_round_robin()) == [list(range(8)), list(range(8, 14))]
    assert paths(f.flatten_merge()) == [list(range(8)), list(range(8, 14))]
    assert paths(f.flatten_concat()) == [[0, 3, 6, 1, 4, 7, 2, 5], [8, 11, 9, 12, 10, 13]]
    assert paths(f.flatten_to_seq(F.col("value")), "row") == [[[0, 1, 2], [3, 4, 5]], [[8, 9, 10], [11, 12, 13]]]
    assert paths(f.with_columns(w=-F.col("value")).flatten_sorted("w")) == [list(range(8))[::-1], list(range(8, 14))[::-1]]
    twice = f.flatten_round_robin().flatten_round_robin()
    assert twice.order == ("turn_2", "group_id") and [r.value for r in twice.sorted().collect()] == [0, 8, 1, 9, 2, 10, 3, 11, 4, 12, 5, 13, 6, 7]


def test_zips_of_placed_frames_move_nothing(spark):
    a, b = values.longs(spark, 0, count=30).drop(3).placed(), values.longs(spark, 100, count=20).placed()
    zipped = a.zip(b, a)
    plan = spark._jvm.PythonSQLUtils.explainString(zipped.df._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    got = [(r.pos, r._1.value, r._2.value, r._3.value) for r in zipped.sorted().collect()]
    assert got == [(i, i + 3, 100 + i, i + 3) for i in range(20)]
    assert zipped.order == ("pos",) and [r.value for r in a.frame().drop(1).sorted().collect()] == list(range(4, 30))
    a.drop()
    with pytest.raises(ValueError):
        values.longs(spark, 0, count=4).inject_round_robin(2).placed()
