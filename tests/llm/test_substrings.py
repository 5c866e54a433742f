"""Operator 11."""

import hashlib
import random
import re
from collections import Counter

import pytest

numpy = pytest.importorskip("numpy")
pytest.importorskip("zstandard")

from millrace.llm import queries, superkmers, words  # noqa: E402


def brute_force(rows, width):
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text), the plain way."""
    last = superkmers.LAST
    split = [(last if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for at in range(len(w) - width + 1):
            key = tuple(w[at : at + width])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), (known, w) in zip(rows, split, strict=True):
        gone = {at + j for at in range(len(w) - width + 1) if least[tuple(w[at : at + width])] < known for j in range(width)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


def results(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def test_odd_rows(documents, rows, empty):
    want = brute_force([(r.doc_id, r.text) for r in rows], 13)
    assert results(superkmers.remove_repeats(documents)) == want
    assert sum(n for (_, _, gone, _), n in want.items() if gone) > 20
    assert superkmers.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("width,minimiser,seed", [(13, 3, 1), (5, 2, 2), (4, 4, 3), (3, 1, 4), (1, 1, 5)])
def test_random_texts(spark, monkeypatch, width, minimiser, seed):
    """Few words in many orders: most windows are found again, and all ways of dealing them agree."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(["a", "b", "cc", "ü"], k=rng.choice([0, 1, 3, 12, 13, 14, 40, 200]))) for _ in range(60)]
    rows = [(rng.randint(0, 30), t) for t in texts] + [(None, texts[5]), (None, None), (99, texts[7].replace(" ", "\t\n "))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_force(rows, width)
    assert results(superkmers.remove_repeats(df, width, minimiser)) == want
    monkeypatch.setattr(superkmers, "HOT_LEAST", 2)
    assert results(superkmers.remove_repeats(df, width, minimiser)) == want


def test_a_hot_group_and_a_hot_line(spark):
    """A third of all rows are copies, and another third share a line with different words around it."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    line = " ".join(f"line{i}" for i in range(9))
    copy = " ".join(word() for _ in range(120))
    rows = [(i, copy) for i in range(1000)] + [(i, " ".join(word() for _ in range(20)) + f"\n{line}\n" + " ".join(word() for _ in range(20))) for i in range(1000, 2000)]
    rows += [(i, " ".join(word() for _ in range(40))) for i in range(2000, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hot = superkmers._hot_bins(df, superkmers.LEAST_BINS, 13, 3)
    assert len(hot) > 0
    got = {r.doc_id: r for r in superkmers.remove_repeats(df).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 120 and got[i].kept == "" for i in range(1, 1000))
    assert all(got[i].n_removed == 0 for i in range(1000, 3000))
    # a hot minimiser's windows go to many buckets, each of them to one
    c = superkmers.Cut([t.encode() for _, t in rows[1000:1100]], 13, 3)
    first, windows, bucket = c.dealt(hot, superkmers.LEAST_BINS, 64)
    single = numpy.isin(first, first[windows == 1])
    assert len(set(bucket[single].tolist())) > 30
    assert windows.sum() == c.windows.sum()


def test_hashes_that_collide():
    """Windows of one hash are told apart by their bytes."""
    texts = [b"x y z", b"x y w", b"x y z", b"longer", b"x y w", b"x y z"]
    buf = numpy.frombuffer(b"\n".join(texts), numpy.uint8)
    size = numpy.array([len(t) for t in texts])
    start = numpy.cumsum(size + 1) - size - 1
    order, same = superkmers.ranked(buf, numpy.full(len(texts), 7, numpy.uint64), start, size)
    groups = {}
    for i, g in zip(order.tolist(), numpy.cumsum(~same).tolist(), strict=True):
        groups.setdefault(g, set()).add(texts[i])
    assert sorted(map(sorted, groups.values())) == [[b"longer"], [b"x y w"], [b"x y z"]]
    assert (~same).sum() == 3


def test_super_k_mers_hold_each_window_once():
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", k=n)).encode() for n in (0, 5, 13, 14, 100, 1000)]
    c = superkmers.Cut(texts, 13, 3)
    begins = [int(f) + i for f, n in zip(c.first, c.windows, strict=True) for i in range(n)]
    want = [int(b) + i for b, n in zip(c.bounds, numpy.diff(c.bounds), strict=False) for i in range(int(n) - 12)]
    assert begins == want and c.windows.max() <= 11
    seeds = words.Words(texts).spans(3)
    assert all(h == seeds[b : b + 11].min() for f, n, h in zip(c.first, c.windows, c.hashes, strict=True) for b in range(f, f + n))


def test_agrees_with_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = db.execute(queries.oracle_sql()["op11_substrings"]).fetchall()
    got = queries.op11_substrings(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_removed > 0 for r in got) > 50
    none = hashlib.sha256(b"").hexdigest()
    assert any(r.kept_sha256 == none for r in got)


def test_texts_move_once(spark):
    """The blocks' texts move once, for both uses."""
    df = superkmers.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
