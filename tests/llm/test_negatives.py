"""Operator 12."""

import pytest

numpy = pytest.importorskip("numpy")

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import negatives, queries, slabs  # noqa: E402


def brute_force(rows, every):
    """Sorted rows of the result for rows (vec_id, embedding, label), the plain way."""
    floor = lambda x: max(-(2**63) + 1, min(2**63 - 1, int(numpy.floor(float(numpy.float32(x)) * 256))))
    rows = [(i, [floor(x) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and numpy.isfinite(x) for x in v)]
    least = lambda i: -(2**63) if i is None else i
    dot = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for n, (i, a, label) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted((-dot(a, v), least(j), m != label) for k, (j, v, m) in enumerate(rows) if k != n)
        for s, p, _ in [x for x in scored if not x[2]][:5]:
            fit = [x for x in scored if x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, None if p == -(2**63) else p, r + 1, None if j == -(2**63) else j, -s, -t) for r, (t, j, _) in enumerate(fit)]
    return sorted(out, key=str)


def results(df):
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=str)


ODD = [
    (100, [float("nan")] * 64, 1), (200, [0.5] * 64, 1), (200, [0.5] * 64, 1), (200, [0.5] * 64, 2), (300, [0.5] * 64, None), (10**6, None, 1), (10**6 + 100, [1.0, None], 1), (10**7, [0.25] * 3, 1), (10**7 + 1, [0.4] * 64, 3),
    (10**7 + 50, [], 1), (10**7 + 2, [float("inf")], 1), (None, [0.45] * 64, 1), (None, [0.3] * 64, 4), (-50, [-0.5] * 64, 1), (-51, [0.5] * 64, 7),
]


@pytest.mark.parametrize("block_vectors,block_queries,leaf,first", [(4096, 1024, 128, 64), (37, 7, 5, 64), (37, 7, 4, 2)])
def test_odd_rows(spark, monkeypatch, block_vectors, block_queries, leaf, first):
    monkeypatch.setattr(slabs, "FIRST_SLABS", first)
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    df = base.unionByName(spark.createDataFrame(ODD, base.schema)).withColumn("row_id", F.lit("x")).withColumn("place", F.lit(1)).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 50 == 0, block_vectors=block_vectors, block_queries=block_queries, leaf=leaf)
    want = brute_force([(r.vec_id, r.embedding, r.label) for r in df.collect()], 50)
    assert results(got) == want and len(want) > 50


def test_ties_and_one_hot_label(spark):
    """Few different vectors, so most scores are ties, and nearly all rows of one label."""
    rng = numpy.random.default_rng(4)
    points = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in points[i % 12]], 0 if i % 9 else 1 + i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    want = brute_force(rows, 50)
    assert results(negatives.mine(df, F.col("vec_id") % 50 == 0, block_vectors=64, leaf=8)) == want and len(want) > 20


def test_scores_beyond_a_long(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, -1.0], 1), (2, [2e19, 1.0], 2), (3, [1e10, 2.0], 2), (4, [7e15, 0.5], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert results(negatives.mine(df, F.col("vec_id") % 2 == 0)) == brute_force(rows, 2)


def test_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.75, 0.0], 2), (3, [-1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    got = negatives.mine(df, F.col("vec_id") == 0)
    assert results(got) == [(0, 1, 1, 2, 65536, 49152)]
    assert negatives.mine(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0
    assert negatives.mine(df.where("label = 1"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.0])
def test_bounds_hold_and_leave_leaves_out(spread):
    rng = numpy.random.default_rng(7)
    centers = rng.normal(size=(6, 5)) * 500
    data = numpy.rint(centers[rng.integers(0, 6, 600)] + rng.normal(size=(600, 5)) * 500 * spread).astype(numpy.int64)
    tree = negatives.Tree(data, leaf=16)
    assert sorted(numpy.concatenate([own for own, _ in tree.leaves]).tolist()) == list(range(600))
    queries_ = data[:50].astype(float)
    least, highest = tree.bounds(queries_)
    exact = queries_ @ data.T
    for i, (own, _) in enumerate(tree.leaves):
        assert (exact[:, own].min(1) >= least[i]).all() and (exact[:, own].max(1) <= highest[i]).all()
    if spread < 1:  # a third best score leaves most leaves out
        third = numpy.sort(exact, axis=1)[:, -3]
        assert (highest >= third).mean() < 0.6


def test_agrees_with_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = db.execute(queries.oracle_sql()["op12_negatives"]).fetchall()
    got = queries.op12_negatives(spark, sf).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
