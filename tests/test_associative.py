"""Associative folds and scans by functions, and groups within a time of an unkeyed stream, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace import positions
from millrace.frame import OrderedFrame

M = 1_000_003


def lift(r):
    return [r[0] % 7 + 1, r[0]]


def combine(f, g):
    """First f, then g: maps x -> a x + b."""
    return [f[0] * g[0] % M, (f[1] * g[0] + g[1]) % M]


def frame(spark, xs, by=()):
    rows = [(i * 3 + 1, i % 3, x) for i, x in enumerate(xs)]
    random.Random(2).shuffle(rows)
    return OrderedFrame.of(spark.createDataFrame(rows, "k long, key long, x long"), "k", by)


@pytest.mark.parametrize("chunk", [4, 1_000_000])
@pytest.mark.parametrize("n", [0, 1, 23])
def test_affine_maps(spark, monkeypatch, chunk, n):
    monkeypatch.setattr(positions, "CHUNK_ROWS", chunk)
    xs = [random.Random(n + i).randint(0, 1000) for i in range(n)]
    f = frame(spark, xs)
    want = list(itertools.accumulate((lift((x,)) for x in xs), combine, initial=[1, 5]))
    assert f.fold_by(lift, combine, [1, 5], ["x"], "array<long>").first()[0] == want[-1]
    got = f.scan_by(lift, combine, [1, 5], ["x"], "array<long>")
    assert [(r.pos, r.scanned) for r in got.sorted().collect()] == list(enumerate(want, start=-1))
    keyed = frame(spark, xs, "key")
    folded = {r.key: r.folded for r in keyed.fold_by(lift, combine, [1, 5], ["x"], "array<long>").collect()}
    scans = {}
    for r in keyed.scan_by(lift, combine, [1, 5], ["x"], "array<long>").sorted().collect():
        scans.setdefault(r.key, []).append(r.scanned)
    for key in range(min(3, n)):
        own = list(itertools.accumulate((lift((x,)) for x in xs[key::3]), combine, initial=[1, 5]))
        assert folded[key] == own[-1] and scans[key] == own
    assert len(folded) == len(scans) == min(3, n)


def test_structs_as_states(spark):
    """The longest run of equal values: a state is a dict."""
    xs = [1, 1, 2, 2, 2, 3, 1, 1, 1, 1]

    def run(r):
        return {"first": r[0], "head": 1, "last": r[0], "tail": 1, "most": 1, "n": 1}

    def join(a, b):
        if not a["n"] or not b["n"]:
            return b if not a["n"] else a
        same = a["last"] == b["first"]
        return {
            "first": a["first"], "head": a["head"] + (b["head"] if same and a["head"] == a["n"] else 0), "last": b["last"],
            "tail": b["tail"] + (a["tail"] if same and b["tail"] == b["n"] else 0), "most": max(a["most"], b["most"], a["tail"] + b["head"] if same else 0), "n": a["n"] + b["n"],
        }

    none = {"first": 0, "head": 0, "last": 0, "tail": 0, "most": 0, "n": 0}
    got = frame(spark, xs).fold_by(run, join, none, ["x"], "struct<first:long,head:long,last:long,tail:long,most:long,n:long>").first()[0]
    assert (got["most"], got["tail"], got["n"]) == (4, 4, 10)


def test_no_task_has_all_rows(spark, monkeypatch):
    monkeypatch.setattr(positions, "CHUNK_ROWS", 50)
    f = frame(spark, list(range(1000)))
    plan = spark._jvm.PythonSQLUtils.explainString(f.fold_by(lift, combine, [1, 0], ["x"], "array<long>")._jdf.queryExecution(), "simple")
    serial = plan.index("SinglePartition") if "SinglePartition" in plan else plan.index("RoundRobinPartitioning(1)")
    # the one task that there is comes after chunks have become a state each
    assert "MapInArrow" in plan[serial:] and plan.count("MapInArrow") == 3  # two, and what is added for an empty stream looks for rows


def grouped(rows, most, micros):
    out = []
    for t, x in rows:
        if not out or len(out[-1][1]) >= most or t - out[-1][0] >= micros:
            out.append((t, []))
        out[-1][1].append(x)
    return out


@pytest.mark.parametrize("chunk", [6, 1_000_000])
@pytest.mark.parametrize("most,micros,jumps", [(1, 10, 3), (4, 10, 3), (5, 100, 3), (13, 20, 3), (40, 25, 3), (7, 12, -30), (1000, 10**9, 3), (3, 1, 0)])
def test_grouped_within_of_one_stream(spark, monkeypatch, chunk, most, micros, jumps):
    """Times that rise, and times that go back now and then."""
    monkeypatch.setattr(positions, "CHUNK_ROWS", chunk)
    rng, t, rows = random.Random(most * micros), 0, []
    for i in range(61):
        t += rng.choice([0, 1, 2, abs(jumps), jumps if i % 9 == 8 else 4])
        rows.append((t, i))
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "k long, t long, x long").select("k", F.timestamp_micros("t").alias("ts"), "x").repartition(3)
    f = OrderedFrame.of(df, "k").grouped_within(most, micros, "ts", "x")
    got = [(r.group_id, r.started, r.group) for r in f.sorted().collect()]
    assert got == [(i, a, b) for i, (a, b) in enumerate(grouped(rows, most, micros))]


def test_grouped_within_of_none(spark):
    f = OrderedFrame.of(spark.createDataFrame([], "k long, ts timestamp, x string"), "k").grouped_within(3, 10, "ts", "x")
    assert f.df.count() == 0 and f.df.columns == ["group_id", "started", "group"]


def test_grouped_within_has_no_single_task(spark, monkeypatch):
    """But for what is a row a chunk, no exchange leads to one partition."""
    monkeypatch.setattr(positions, "CHUNK_ROWS", 100)
    rows = spark.range(1000).select(F.col("id").alias("k"), F.timestamp_micros("id").alias("ts"), F.col("id").alias("x"))
    f = OrderedFrame.of(rows, "k").grouped_within(7, 5, "ts", "x")
    plan = spark._jvm.PythonSQLUtils.explainString(f.df._jdf.queryExecution(), "formatted")
    assert f.df.count() == 200
    assert plan.count("SinglePartition") + plan.count("RoundRobinPartitioning(1)") <= 1
