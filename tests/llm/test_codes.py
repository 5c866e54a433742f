"""Operator 13."""

import hashlib

import pytest

numpy = pytest.importorskip("numpy")

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import codes, queries  # noqa: E402


def plain(rows, parts=4, n_entries=256, rounds=4, scale=1024):
    """{(vec_id, code, error, label_error): times} and the digest, in plain Python."""
    rows = [(i, [max(-(2**63), min(2**63 - 1, int(numpy.floor(float(numpy.float32(x)) * scale)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and numpy.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in rows), default=0) // parts))
    rows = sorted(((i, v + [0] * (parts * width - len(v)), label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[r[1][p * width : (p + 1) * width] for r in rows[:n_entries]] for p in range(parts)]

    def assigned():
        for i, v, label in rows:
            found = []
            for p in range(parts):
                x = v[p * width : (p + 1) * width]
                found.append(min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])))
            yield i, v, label, found

    for _ in range(rounds):
        sums = {}
        for _, v, _, found in assigned():
            for p, (_, k) in enumerate(found):
                sums.setdefault((p, k), []).append(v[p * width : (p + 1) * width])
        for (p, k), own in sums.items():
            books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [(i, "".join(f"{k:02x}" for _, k in found), min(2**63 - 1, sum(d for d, _ in found)), label) for i, _, label, found in assigned()]
    total = {}
    for _, _, e, label in last:
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(2**63 - 1, total[label])) for i, c, e, label in last), key=str), digest


ODD = [
    (5, [float("nan")] * 64, 1), (5, [0.5] * 64, 1), (5, [0.5] * 64, 1), (10**6, None, 1), (10**6 + 7, [1.0, None], 1), (10**7, [0.25] * 3, None), (10**7 + 1, [], None), (10**7 + 2, [float("inf")], 1), (None, [-0.125] * 64, 3), (-4, [1.0] * 61, 2),
]


@pytest.mark.parametrize("n_entries,rounds", [(256, 4), (7, 2), (256, 0)])
def test_codes_of_odd_rows(spark, n_entries, rounds):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 300")
    df = base.unionByName(spark.createDataFrame(ODD, base.schema)).withColumn("code", F.lit("x")).withColumn("slot", F.lit(1)).repartition(3)
    got = codes.codes(df, n_entries=n_entries, rounds=rounds).collect()
    want, digest = plain([(r.vec_id, r.embedding, r.label) for r in df.collect()], n_entries=n_entries, rounds=rounds)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_components_beyond_doubles(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [-3e38, 2.0], 1), (2, [1e10, -5.0], None), (3, [9e9, 3.5], None), (4, [0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = codes.codes(df, n_entries=2).collect()
    want, digest = plain(rows, n_entries=2)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_none_and_one(spark):
    one = spark.createDataFrame([(3, [0.5, -0.5], None)], "vec_id long, embedding array<float>, label int")
    assert codes.codes(one.limit(0)).count() == 0
    r = codes.codes(one).first()
    assert (r.vec_id, r.code, r.error, r.label_error) == (3, "00000000", 0, 0)


@pytest.mark.parametrize("spread", [0, 3, 1000])
def test_tree_finds_the_nearest_and_leaves_some_out(spread):
    rng = numpy.random.default_rng(spread)
    centers = rng.integers(-1000, 1000, (8, 4))
    entries = centers[rng.integers(0, 8, 200)] + (rng.integers(-spread, spread + 1, (200, 4)) if spread else 0)
    rows = numpy.concatenate([entries[:100], centers[rng.integers(0, 8, 300)] + rng.integers(-9, 9, (300, 4))])
    tree = codes.Tree(entries, leaf=4)
    at, near = tree.nearest(rows)
    every = ((rows[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    assert (near == every.min(1)).all() and (at == every.argmin(1)).all()  # argmin: ties to the lower index
    if spread == 3:
        assert tree.visited < 0.7 * every.size


def test_agrees_with_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = db.execute(queries.oracle_sql()["op13_codes"]).fetchall()
    got = queries.op13_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_labels_ways_agree(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = sorted(map(tuple, codes.codes(df, n_entries=16, rounds=1).collect()))
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, codes.codes(df, n_entries=16, rounds=1).collect())) == want
