"""Operators against the same on plain Python lists."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.frame import OrderedFrame
from millrace.operators import groups
from millrace.operators.cycles import feedback

LENGTHS = [0, 1, 19]


def values(n, seed=1, most=5):
    return [random.Random(seed * 1000 + n).randint(1, most) for _ in range(n)]


def frame(spark, xs, kind="long"):
    rows = [(i * 3 + 1, x) for i, x in enumerate(xs)]
    random.Random(len(xs)).shuffle(rows)
    return OrderedFrame.of(spark.createDataFrame(rows, f"k long, x {kind}"), "k")


def out(f, column="x"):
    return [r[column] for r in f.sorted().collect()]


@pytest.fixture(params=["one chunk", "many chunks"])
def chunks(request, monkeypatch):
    from millrace import positions

    if request.param == "many chunks":
        monkeypatch.setattr(positions, "CHUNK_ROWS", 6)


@pytest.mark.parametrize("n", LENGTHS)
def test_slices(spark, chunks, n):
    xs = list(range(n))
    f = frame(spark, xs)
    assert out(f.take(4)) == xs[:4]
    assert out(f.take(0)) == []
    assert out(f.take(9)) == xs[:9] and out(f.take_last(9)) == xs[-9:]  # of many chunks: more than one holds
    assert out(f.drop(4)) == xs[4:]
    assert out(f.drop_last(3)) == xs[: max(0, n - 3)]
    assert out(f.take_last(3)) == (xs[-3:] if n else [])
    assert out(f.take_last(0)) == []
    assert out(f.slice(2, 3)) == xs[2:5]
    assert out(f.element_at(2)) == xs[2:3]
    assert out(f.slice_every(3, 4)) == [x for x in xs if x % 7 >= 3]
    assert out(f.take_every_nth(3)) == xs[2::3]
    assert out(f.drop_all()) == []


@pytest.mark.parametrize("n", LENGTHS)
def test_whiles_and_neighbours(spark, chunks, n):
    xs = values(n)
    f = frame(spark, xs)
    assert out(f.take_while(F.col("x") < 5)) == list(itertools.takewhile(lambda x: x < 5, xs))
    assert out(f.drop_while(F.col("x") < 5)) == list(itertools.dropwhile(lambda x: x < 5, xs))
    assert out(f.deduplicate()) == [k for k, _ in itertools.groupby(xs)]
    windows = [xs[i : i + 4] for i in range(n - 3)] if n >= 4 else ([xs] if n else [])
    assert out(f.sliding(4, F.col("x")), "window") == windows
    assert out(f.grouped(4, F.col("x")), "group") == [xs[i : i + 4] for i in range(0, n, 4)]


def test_deduplicate_keeps_nulls_apart(spark):
    assert out(frame(spark, [None, None, 1, 1, None]).deduplicate()) == [None, 1, None]


@pytest.mark.parametrize("n", LENGTHS)
def test_scan_and_folds(spark, chunks, n):
    xs = values(n)
    f = frame(spark, xs)
    assert out(f.scan("sum", F.col("x"), 10), "scanned") == list(itertools.accumulate(xs, initial=10))
    assert out(f.scan("max", F.col("x"), 3), "scanned") == list(itertools.accumulate(xs, max, initial=3))
    assert out(f.scan_with(lambda acc, r: acc * 3 % 101 + r[0], 7, ["x"], "long"), "scanned") == list(itertools.accumulate(xs, lambda a, x: a * 3 % 101 + x, initial=7))
    assert f.folding("sum", F.col("x"), 10) == 10 + sum(xs)
    assert f.folding("min", F.col("x"), 4) == min([4, *xs])
    assert f.fold_with(lambda acc, r: acc + str(r[0]), "", ["x"], "string").first()[0] == "".join(map(str, xs))
    assert f.mk_string(F.col("x"), ",", "[", "]").first()[0] == "[" + ",".join(map(str, xs)) + "]"
    assert f.to_mk_string(F.col("x"), 100, ",") == ",".join(map(str, xs))
    if xs:
        assert f.reduce("max", F.col("x")).first()[0] == max(xs)
    else:
        with pytest.raises(PySparkException):
            f.reduce("max", F.col("x")).collect()


def test_elements(spark):
    f = frame(spark, [1, 2, None, 4])
    assert out(f.map(x=F.col("x") + 1)) == [2, 3, None, 5]
    assert out(f.filter(F.col("x") > 1)) == [2, 4]
    assert out(f.filter_not(F.col("x") > 1)) == [1]
    assert out(f.collect_where(F.col("x") > 1, x=F.col("x") * 10)) == [20, 40]
    assert out(f.multiply(2)) == [1, 1, 2, 2, None, None, 4, 4]
    assert out(f.multiply(0)) == []
    assert out(f.duplicate().filter(F.col("x") == 4)) == [4, 4]
    assert out(frame(spark, ["a b", "", None], "string").flat_map(F.split("x", " "), "w"), "w") == ["a", "b", ""]
    assert out(frame(spark, ["1", "x", "3"], "string").filter_type("x", "int")) == [1, 3]
    assert out(f.map_async(3, lambda r: {"k": r["k"], "y": r["k"] * 2}, "k long, y long"), "y") == [2, 8, 14, 20]
    assert out(f.buffer(10).async_boundary(2).identity().via(lambda g: g.take(1))) == [1]


@pytest.mark.parametrize("n", LENGTHS)
def test_intersperse(spark, chunks, n):
    xs = [str(x) for x in values(n)]
    f = frame(spark, xs, "string")
    between = list(itertools.chain.from_iterable((",", x) for x in xs))[1:]
    assert out(f.intersperse("x", F.lit(","))) == between
    assert out(f.intersperse("x", F.lit(","), F.lit("["), F.lit("]"))) == ["[", *between, "]"]


def sub_streams(f):
    got = {}
    for r in f.df.orderBy("k").collect():
        got.setdefault(r["group_id"], []).append(r["x"])
    return [got[g] for g in sorted(got)]


def test_split_of_one_to_nine(spark, chunks):
    f = frame(spark, list(range(1, 10)))
    assert sub_streams(f.split_when(F.col("x") % 4 == 0)) == [[1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert sub_streams(f.split_after(F.col("x") % 4 == 0)) == [[1, 2, 3, 4], [5, 6, 7, 8], [9]]


def test_split_commands(spark, chunks):
    """Against a state machine over the commands."""
    for seed in range(4):
        rng = random.Random(seed)
        commands = [rng.choice(groups.COMMANDS) for _ in range(25)]
        want, is_open = [], False
        for i, c in enumerate(commands):
            if c == groups.COMPLETE_EMIT:
                is_open = False
            if c not in (groups.DROP, groups.DROP_COMPLETE):
                if not is_open:
                    want.append([])
                    is_open = True
                want[-1].append(i)
            if c in (groups.EMIT_COMPLETE, groups.DROP_COMPLETE):
                is_open = False
        df = spark.createDataFrame([(i, i, c) for i, c in enumerate(commands)], "k long, x long, cmd string")
        got = sub_streams(OrderedFrame.of(df, "k").split(F.col("cmd")))
        assert got == want


def test_group_by(spark):
    f = frame(spark, list(range(20))).with_columns(key=F.col("x") % 8)
    g = f.group_by(8, "key")
    assert {r["key"]: r["folded"] for r in g.fold("sum", F.col("x"), 0).collect()} == {k: sum(range(k, 20, 8)) for k in range(8)}
    with pytest.raises(PySparkException, match="more than 7"):
        f.group_by(7, "key").df.collect()
    with pytest.raises(PySparkException, match="null"):
        f.with_columns(key=F.lit(None).cast("long")).group_by(7, "key").df.collect()


@pytest.mark.parametrize("n", LENGTHS)
def test_prefix_and_tail(spark, chunks, n):
    xs = list(range(n))
    prefix, tail = frame(spark, xs).prefix_and_tail(3, F.col("x"))
    assert [r["prefix"] for r in prefix.collect()] == [xs[:3]]
    assert out(tail) == xs[3:]
    head, tail = frame(spark, xs).head_and_tail(F.col("x"))
    if xs:
        assert head.first()["head"] == 0 and out(tail) == xs[1:]
    else:
        with pytest.raises(PySparkException, match="NoSuchElement"):
            head.collect()


def test_emit_single_empty(spark):
    assert out(frame(spark, []).grouped(3, F.col("x"), emit_single_empty=True), "group") == [[]]
    assert out(frame(spark, [1]).grouped(3, F.col("x"), emit_single_empty=True), "group") == [[1]]


@pytest.mark.parametrize("n,m", [(0, 3), (5, 5), (9, 14)])
def test_fan_in(spark, chunks, n, m):
    xs, ys = list(range(n)), list(range(1000, 1000 + m))
    a, b = frame(spark, xs), frame(spark, ys)
    assert out(a.concat(b)) == xs + ys
    assert sorted(out(a.merge(b))) == sorted(xs + ys)
    assert [x for x in out(a.merge(b)) if x < 1000] == xs
    assert out(a.or_else(b)) == (xs or ys)
    assert [(r["_1"]["x"], r["_2"]["x"]) for r in a.zip(b).sorted().collect()] == list(zip(xs, ys, strict=False))
    p, q, whole = xs[:], ys[:], []
    while p or q:
        whole += p[:3] + q[:3]
        p, q = p[3:], q[3:]
    assert out(a.interleave(b, segment=3)) == whole
    p, q, eager = iter(xs), iter(ys), []
    for turn in itertools.cycle([p, q]):
        own = list(itertools.islice(turn, 2))
        eager += own
        if len(own) < 2:
            break
    assert out(a.interleave(b, segment=2, eager_complete=True)) == eager


def test_merge_sorted_and_either(spark):
    a, b = frame(spark, [1, 3, 5]), frame(spark, [2, 3, 9])
    assert out(a.merge_sorted(b, values=("x",))) == [1, 2, 3, 3, 5, 9]
    rows = a.merge_to_either(b, F.col("x"), F.col("x")).df.collect()
    assert sorted((r["either"]["tag"], r["either"]["left"], r["either"]["right"]) for r in rows if r["either"]["tag"] == "left") == [("left", 1, None), ("left", 3, None), ("left", 5, None)]


def test_fan_out(spark, chunks):
    xs = list(range(20))
    f = frame(spark, xs)
    assert [out(g) for g in f.fan_out_round_robin(3)] == [xs[i::3] for i in range(3)]
    assert [out(g) for g in f.fan_out_sequential([3, 5])] == [xs[:3], xs[3:8], xs[8:]]
    assert [out(g) for g in f.switch(2, F.col("x") % 2)] == [xs[::2], xs[1::2]]
    with pytest.raises(PySparkException, match="no such branch"):
        f.switch(2, F.col("x") % 3)[0].df.collect()
    assert sorted(x for g in f.fan_out_to_any(3) for x in out(g)) == xs
    seen = []
    assert f.tee(lambda g: seen.append(g.df.count())).df.count() == 20 and seen == [20]
    assert [len(x) for x in f.broadcast(out, lambda g: out(g.take(2)), keep=True)] == [20, 2]
    pairs = f.map(p=F.struct(F.col("x").alias("a"), (F.col("x") + 1).alias("b")))
    assert [out(g, c) for g, c in zip(pairs.unzip("p"), "ab", strict=True)] == [xs, [x + 1 for x in xs]]


def test_sub_streams(spark):
    f = frame(spark, list(range(10))).with_columns(g=F.col("x") % 3).sub_streams("g")
    assert out(f.flatten_concat()) == [0, 3, 6, 9, 1, 4, 7, 2, 5, 8]
    assert out(f.flatten_merge()) == list(range(10))
    assert out(f.flatten_round_robin()) == list(range(10))
    assert out(f.flatten_to_seq(F.col("x")), "row") == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    assert out(f.drop_last(1).flatten_merge()) == [0, 1, 2, 3, 4, 5, 6]
    assert out(f.take_while(F.col("x") < 5).flatten_merge()) == [0, 1, 2, 3, 4]
    assert out(f.scan("sum", F.col("x"), 0).flatten_concat(), "scanned") == [0, 0, 3, 9, 18, 0, 1, 5, 12, 0, 2, 7, 15]
    assert sorted(out(frame(spark, [1, 2]).inject_broadcast(2))) == [1, 1, 2, 2]
    assert sub_streams(frame(spark, list(range(5))).inject_sequential(2)) == [[0, 1], [2, 3], [4]]
    assert sub_streams(frame(spark, list(range(5))).inject_round_robin(2)) == [[0, 2, 4], [1, 3]]
    assert sorted(x for g in sub_streams(frame(spark, list(range(5))).inject_to_any(2)) for x in g) == list(range(5))


def test_limits(spark, chunks):
    f = frame(spark, [2] * 10)
    assert out(f.with_limit(10)) == [2] * 10
    with pytest.raises(PySparkException, match="StreamLimitExceeded"):
        f.with_limit(9).df.collect()
    assert len(out(f.with_limit_weighted(20, F.col("x")))) == 10
    with pytest.raises(PySparkException, match="StreamLimitExceeded"):
        f.with_limit_weighted(19, F.col("x")).df.collect()


def test_recovery(spark):
    f, g, h = frame(spark, [1, 2, 3, 4]), frame(spark, [0, -1]), frame(spark, [7])
    ok = F.col("x") != 3
    assert out(f.recover(ok, g)) == [1, 2, 0, -1]
    assert out(f.recover_with(ok, g)) == [1, 2, 0, -1]
    assert out(f.recover_with(ok, frame(spark, [5, 3]), h)) == [1, 2, 5, 7]
    with pytest.raises(PySparkException, match="no recovery"):
        f.recover_with(ok, frame(spark, [5, 3])).df.collect()
    assert out(frame(spark, [1]).recover(ok, g)) == [1]
    tried = f.recover_to_try(F.col("x"), ok, F.lit("bad"))
    assert [tuple(r["result"]) for r in tried.sorted().collect()] == [(True, 1, None), (True, 2, None), (False, None, "bad")]


def test_hooks(spark):
    f, seen = frame(spark, [1, 2, 3]).on_signal("signals", F.sum("x").alias("total"))
    f.ignore()
    assert seen.get == {"elements": 3, "total": 6}
    said = []
    f = frame(spark, [1, 2, 3])
    assert f.run(lambda df: df.count(), lambda: said.append("start"), lambda: said.append("complete"), None, lambda e: said.append(e)) == 3
    assert said == ["start", "complete", None]
    with pytest.raises(ZeroDivisionError):
        f.run(lambda df: 1 / 0, on_error=lambda e: said.append(type(e)))
    assert said[-1] is ZeroDivisionError
    assert out(f.on_element(lambda r: None)) == [1, 2, 3]
    tries = []

    def flaky(df):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return df.count()

    assert f.protect(flaky) == 3
    assert "Scan" in f.render() or "LocalTable" in f.render()


def test_bad_arguments(spark):
    f = frame(spark, [1])
    for call in (lambda: f.take(-1), lambda: f.drop(-1), lambda: f.grouped(0, F.col("x")), lambda: f.sliding(0, F.col("x")), lambda: f.take_every_nth(0), lambda: f.first_rows(0), lambda: OrderedFrame.of(f.df, "nothing"), lambda: OrderedFrame.of(f.df, ())):
        with pytest.raises(ValueError):
            call()


def test_feedback(spark):
    """Halving until 1: what a cycle in a graph would do."""
    start = frame(spark, [5, 8])
    halved = feedback(start, lambda f: f.filter(F.col("x") > 1).with_columns(x=F.floor(F.col("x") / 2)), 10)
    assert [(r["round"], r["x"]) for r in halved.sorted().collect()] == [(0, 5), (0, 8), (1, 2), (1, 4), (2, 1), (2, 2), (3, 1)]
    assert out(feedback(frame(spark, []), lambda f: f, 3)) == []
    with pytest.raises(RuntimeError):
        feedback(start, lambda f: f, 3)


def test_settled(spark):
    f = frame(spark, [3, 1, 2]).settled()
    assert out(f.drop(1)) == [1, 2]
