"""Operators 5 and 8."""

from collections import Counter, defaultdict

import pytest

numpy = pytest.importorskip("numpy")

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import sharding, slabs, topk  # noqa: E402


def brute_force(rows, every, k):
    width = max((len(v) for _, v in rows), default=0)
    ids = numpy.array([i for i, _ in rows])
    data = numpy.array([numpy.pad(numpy.floor(numpy.array(v, float) * 1024).astype(numpy.int64), (0, width - len(v))) for _, v in rows]).reshape(len(rows), width)
    out = []
    for j, (i, _) in enumerate(rows):
        if i % every == 0:
            scores = data @ data[j]
            best = [x for x in numpy.lexsort((ids, -scores)) if x != j][:k]
            out += [(i, n + 1, int(ids[x]), int(scores[x])) for n, x in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block_vectors,block_queries,slab,first", [(4096, 512, 1 << 16, 64), (37, 3, 80, 64), (37, 3, 37, 2)])
def test_top_k(spark, monkeypatch, block_vectors, block_queries, slab, first):
    monkeypatch.setattr(slabs, "SLAB_VECTORS", slab)
    monkeypatch.setattr(slabs, "FIRST_SLABS", first)
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    odd = spark.createDataFrame([(100, [float("nan")] * 64, 1), (200, [0.5] * 64, 1), (200, [0.5] * 64, 1), (10**6, None, 1), (10**6 + 100, [1.0, None], 1), (10**7, [0.25] * 3, 1), (10**7 + 1, [], 1), (10**7 + 2, [float("inf")], 1)], base.schema)
    df = base.unionByName(odd).withColumn("row_id", F.lit("x")).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, block_vectors=block_vectors, block_queries=block_queries).collect()
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and all(x is not None and numpy.isfinite(x) for x in r.embedding)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_force(rows, 100, 10)


def test_top_k_agrees_with_sql(spark):
    import duckdb

    from millrace.llm import queries

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = db.execute(queries.oracle_sql()["op5_topk"]).fetchall()
    assert sorted(map(tuple, queries.op5_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, -1.0]), (2, [-3e38, 1.0]), (3, [1e10, 2.0]), (4, [1e9, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.score for r in topk.top_k(df, F.col("vec_id") == 0).collect()}
    first = lambda x: min(2**63 - 1, max(-(2**63) + 1, int(numpy.floor(float(numpy.float32(x)) * 1024))))
    want = {i: min(2**63 - 1, max(1 - 2**63, first(3e38) * first(x) + 1024 * first(y))) for i, x, y in ((1, 3e38, -1.0), (2, -3e38, 1.0), (3, 1e10, 2.0), (4, 1e9, 0.0))}
    assert got == want


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (100, [-1.0, 2.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 1 << 20), (0, 2, 100, -(1 << 20)), (100, 1, 1, 1 << 20), (100, 2, 0, -(1 << 20))]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_slabs_beyond_the_first_give_what_reaches_the_floor(spark, monkeypatch):
    """Rows that slabs return: k of each query in the first ones, in the others no more than are among the best."""
    rng = numpy.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(1200)], "vec_id long, embedding array<double>").repartition(4)
    given = []
    past = topk.past
    monkeypatch.setattr(topk, "past", lambda *a, **k: (lambda found: (given.append((a[5], found.count())), found)[1])(past(*a, **k)))
    monkeypatch.setattr(slabs, "SLAB_VECTORS", 40)
    whole = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, block_vectors=40).collect()))
    monkeypatch.setattr(slabs, "FIRST_SLABS", 8)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, block_vectors=40).collect())) == whole
    (_, every), (first, n_first), (rest, n_rest) = given
    assert len(first) == 8 and len(rest) > 20 and n_first + n_rest < 0.6 * every and n_rest < 12 * 10 * len(rest) / 4


def test_search_stops_before_the_end():
    """With a few large components most segments are never read, and results are those of all."""
    rng = numpy.random.default_rng(2)
    data = rng.integers(-20, 21, (3000, 16))
    data[:40] += (rng.integers(0, 2, (40, 16)) * 2 - 1) * 1000
    queries = data[:8]
    index = topk.Index(data, levels=100)
    read = []

    class Counted(list):
        def __getitem__(self, i):
            read.append(i)
            return super().__getitem__(i)

    index.segments = Counted(index.segments)
    ids = numpy.arange(3000)
    for i, found, scores in topk.search(queries, ids[:8], index, ids, ids, 5):
        exact = data @ queries[i]
        exact[i] = -(10**15)
        want = numpy.lexsort((ids, -exact))[:5]
        assert found.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
    assert max(read) < len(index.segments)


def buckets(hashes, limit):
    """Extendible hashing, the plain way: {depth and prefix: bytes}."""
    out, todo = {}, [(0, 0, list(hashes))]
    while todo:
        depth, prefix, own = todo.pop()
        n = sum(b for _, b in own)
        if n <= limit or depth == 64:
            if own:
                out[depth, prefix] = n
            continue
        for bit in (0, 1):
            todo.append((depth + 1, prefix << 1 | bit, [(h, b) for h, b in own if h >> (63 - depth) & 1 == bit]))
    return out


@pytest.mark.parametrize("limit", [20_000, 3_000, 10**9])
def test_shards(documents, limit):
    got = sharding.shard(documents, limit).collect()
    rows = documents.select(sharding.key(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("b")).collect()
    want = buckets([(r.h % 2**64, r.b) for r in rows], limit)
    assert len(got) == len(rows)
    sizes, declared = Counter(), {}
    for r in got:
        sizes[r.shard] += r.n_bytes
        declared[r.shard] = r.shard_bytes
    assert sizes == declared
    plain = {(r.depth, int(r.shard.split("/")[0], 16)): r.shard_bytes for r in got if r.depth < 64}
    assert plain == {k: v for k, v in want.items() if k[0] < 64}
    largest = defaultdict(int)
    for r in got:
        largest[r.shard] = max(largest[r.shard], r.n_bytes)
    assert all(n <= limit or (n == largest[s]) for s, n in sizes.items())


def test_shards_of_one_hot_id(spark):
    df = spark.createDataFrame([(5, "x" * (i % 90))for i in range(2000)] + [(i, "y" * 10) for i in range(300)] + [(None, None)], "doc_id long, text string").repartition(6)
    got = sharding.shard(df, 500).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
    assert len(got) == 2301 and max(sizes.values()) <= 500
    assert len(sizes) < 3 * sum(r.n_bytes for r in got) / 500 + 200


def test_shards_of_nothing(empty):
    assert sharding.shard(empty, 100).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(empty, 0)


def test_shards_run_no_python(documents):
    plan = documents.sparkSession._jvm.PythonSQLUtils.explainString(sharding.shard(documents, 20_000)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_agree_with_sql(spark, sf):
    import duckdb

    from millrace.llm import queries

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    want = db.execute(queries.oracle_sql()["op8_sharding"]).fetchall()
    got = queries.op8_sharding(spark, f"/root/testdata/{sf}").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({r.shard for r in got}) > 16


def test_many_small_shards(spark):
    """Some 10**5 prefixes: all of them in the first pass, and each row in one shard."""
    df = spark.range(200_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("text"))
    got = sharding.shard(df, 100).groupBy("shard").agg(F.sum("n_bytes").alias("n"), F.first("shard_bytes").alias("declared"), F.count("*").alias("rows")).collect()
    assert sum(r.rows for r in got) == 200_000 and all(r.n == r.declared <= 100 for r in got)
    assert 39_000 < len(got) < 150_000
