"""Operators 2 and 4 against brute force."""

import os
import random
import re
from collections import defaultdict

import pytest

numpy = pytest.importorskip("numpy")

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import neardup, repeats  # noqa: E402
from millrace.llm.words import Words  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_classes(texts, k=5, threshold=0.8):
    """Sets of the numbers of texts that are linked."""
    words = [WORD.findall(t or "") for t in texts]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()) for w in words]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = defaultdict(int)
    for v in holders.values():
        for b in range(len(v)):
            for a in range(b):
                common[v[a], v[b]] += 1
    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            parent[root(a)] = root(b)
    out = defaultdict(set)
    for i in range(len(sets)):
        out[root(i)].add(i)
    return sorted(map(sorted, out.values()))


def found_classes(df):
    out = defaultdict(list)
    for r in neardup.classes(df).collect():
        out[r.class_id].append(r.doc_id)
    return sorted(map(sorted, out.values()))


def test_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(1200)]
    keys, weights, of = neardup.elements(Words([" ".join(words[:1000]).encode(), " ".join(words[150:1150]).encode()]), 5, False)
    s = neardup.signatures(keys, weights, of, 2, 4096)
    assert abs((s[0] == s[1]).mean() - 846 / 1146) < 0.03


def test_signatures_of_weights():
    keys = numpy.array([11, 22, 33] * 2, numpy.uint64) * numpy.uint64(0x9E3779B97F4A7C15)
    weights = numpy.array([5.0, 1.5, 0.2, 2.0, 2.0, 0.9])
    s = neardup.signatures(keys, weights, numpy.array([0, 0, 0, 1, 1, 1]), 2, 8192)
    assert abs((s[0] == s[1]).mean() - (2 + 1.5 + 0.2) / (5 + 2 + 0.9)) < 0.03
    assert (s != 2**64 - 1).all()


def test_a_text_alone_or_among_others_has_the_same_signature():
    texts = [b"one", b" ".join(b"a%d" % i for i in range(900)), b"x y z a b c", b""]
    whole = neardup.signatures(*neardup.elements(Words(texts), 5, False), 4, 192)
    for i, t in enumerate(texts):
        assert (neardup.signatures(*neardup.elements(Words([t]), 5, False), 1, 192)[0] == whole[i]).all()


def test_near_duplicates_of_the_table(spark, documents):
    rows = [(i, r.text) for i, r in enumerate(documents.select("text").collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_classes(df) == near_classes([t for _, t in rows])


def test_large_groups(spark, monkeypatch):
    """Many copies, many near copies, a chain of near copies, and texts that share a passage without being near."""
    rng = random.Random(3)
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = ["same text of more than five words"] * 60
    for _ in range(80):
        w = base[:]
        w[rng.randrange(120)] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    chain = [f"c{rng.randint(0, 10**6)}" for _ in range(120)]
    for _ in range(30):
        chain = [*chain[4:], *(f"c{rng.randint(0, 10**6)}" for _ in range(4))]
        texts.append(" ".join(chain))
    shared = [f"s{i}" for i in range(100)]
    texts += [" ".join(shared + [f"t{rng.randint(0, 10**6)}" for _ in range(80)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = near_classes(texts)
    assert found_classes(df) == want
    for hot, most in ((10, 100_000), (10, 0)):
        monkeypatch.setattr(neardup, "HOT_BAND", hot)
        monkeypatch.setattr(neardup, "BROADCAST_BANDS", most)
        assert found_classes(df) == want


def test_pairs_hidden_in_families(spark, monkeypatch):
    """Families of texts at 0.6 to each other, and in each a few at 0.84 that nothing sets apart."""
    rng = random.Random(11)
    texts = []
    for f in range(5):
        template = [f"f{f}w{rng.randint(0, 10**6)}" for _ in range(120)]

        def edited(n, template=template):
            w = template[:]
            for i in rng.sample(range(6, 114), n):
                w[i] = f"e{rng.randint(0, 10**9)}"
            return " ".join(w)

        own = [edited(3) for _ in range(200)]
        for _ in range(3):
            own.insert(rng.randint(40, 160), edited(1))
        texts += own
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = near_classes(texts)
    assert found_classes(df) == want
    monkeypatch.setattr(neardup, "HOT", 10)
    assert found_classes(df) == want


def test_pairs_of_one_template(spark):
    """500 texts of one template at some 0.76 to each other, and 250 pairs at 0.82 among them: none is lost."""
    rng = random.Random(21)
    template = [f"w{rng.randint(0, 10**7)}" for _ in range(2000)]
    texts = []
    for _ in range(250):
        places = rng.sample(range(8, 1990, 6), 48)
        own = template[:]
        for at in places[:8]:
            own[at] = f"p{rng.randint(0, 10**9)}"
        for some in (places[8:28], places[28:]):
            w = own[:]
            for at in some:
                w[at] = f"e{rng.randint(0, 10**9)}"
            texts.append(" ".join(w))
    number, sets = {}, []
    for t in texts:
        w = t.split(" ")
        sets.append([number.setdefault(tuple(w[i : i + 5]), len(number)) for i in range(len(w) - 4)])
    holds = numpy.zeros((500, len(number)), numpy.float32)
    for i, own in enumerate(sets):
        holds[i, own] = 1
    common, n = holds @ holds.T, holds.sum(1)
    links = {(int(a), int(b)) for a, b in numpy.argwhere(common >= 0.8 * (n[:, None] + n[None, :] - common)) if a < b}
    assert links == {(i, i + 1) for i in range(0, 500, 2)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert found_classes(df) == sorted(map(list, links))


def test_recall_of_mixed_texts(spark):
    """5,000 texts in pairs of all similarities around the threshold: every pair of it or more is linked."""
    rng = random.Random(22)
    texts = []
    for i in range(2500):
        n = rng.choice([30, 80, 200, 400])
        w = [f"m{rng.randint(0, 10**6)}" for _ in range(n)]
        v = w[:]
        for at in rng.sample(range(n), max(1, rng.randint(0, max(1, n // 25)))):
            v[at] = f"x{rng.randint(0, 10**9)}"
        texts += [" ".join(w), " ".join(v)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want, have = near_classes(texts), found_classes(df)
    links = lambda classes: {tuple(c) for c in classes if len(c) > 1}
    assert links(have) <= links(want)
    assert len(links(have)) >= 0.999 * len(links(want)) > 800


def test_deduplicate(documents, empty):
    out = neardup.deduplicate(documents)
    assert out.dtypes == documents.dtypes
    rows = documents.collect()
    classes = near_classes([r.text for r in rows])
    kept = [r.doc_id for r in out.collect()]
    least = [min((rows[i].doc_id for i in c if rows[i].doc_id is not None), default=None) for c in classes]
    assert sorted(kept, key=str) == sorted(least, key=str)
    assert neardup.deduplicate(empty).count() == 0 == neardup.near_duplicates(empty).count()


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    rng.shuffle(path)
    got = {r.node: r["class"] for r in neardup.components(spark.createDataFrame([*path, *star, (7, 7)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def repeated_words(texts, n):
    places = defaultdict(list)
    words = [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - n + 1):
            places[tuple(w[k : k + n])].append((i, k))
    out = defaultdict(set)
    for v in places.values():
        if len(v) > 1:
            for i, k in v:
                out[i].update(range(k, k + n))
    return words, dict(out)


@pytest.mark.parametrize("block_bytes,n,seed,hot", [(20_000, 50, 8, 20_000), (1 << 20, 20, 20, 20_000), (5_000, 12, 1, 20_000), (20_000, 50, 8, 3), (5_000, 12, 1, 20)])
def test_repeats(spark, documents, monkeypatch, block_bytes, n, seed, hot):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [(i, r.text, "x") for i, r in enumerate(documents.select("text").collect()) if r.text is None or len(r.text) < 100_000]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3).cache()
    words, want = repeated_words([t for _, t, _ in rows], n)
    ids = [i for i, _, _ in rows]
    have, cuts = defaultdict(set), defaultdict(set)
    for r in repeats.repeated_spans(df, n, seed).collect():
        (cuts if r.cut else have)[ids.index(r.doc_id)].update(range(r.start, r.end))
        assert r.n_words == len(words[ids.index(r.doc_id)])
    assert dict(have) == want
    assert all(c <= have[i] for i, c in cuts.items())
    out = {r.doc_id: r.text for r in repeats.remove(df, n, seed).collect()}
    for i, (doc_id, text, _) in enumerate(rows):
        left = [w for k, w in enumerate(words[i]) if k not in cuts[i]]
        if cuts[i] and not left:
            assert doc_id not in out
        else:
            assert WORD.findall(out[doc_id] or "") == left
            assert cuts[i] or out[doc_id] == text


def test_reach_of_suffixes():
    """The most words in common with any other suffix of the seed, against all pairs."""
    rng = numpy.random.default_rng(4)
    seeds = rng.integers(0, 6, 300).astype(numpy.uint64)
    words = rng.integers(0, 2, (300, 9)).astype(numpy.uint16)
    got = repeats._reach(seeds, words)
    for i in range(300):
        others = [j for j in range(300) if j != i and seeds[j] == seeds[i]]
        assert got[i] == max((int(numpy.cumprod(words[i] == words[j]).sum()) for j in others), default=0)


def test_windows_that_no_single_suffix_matches(spark):
    """Texts that match in shifted parts, so that the neighbours to the left and right differ."""
    rng = random.Random(12)
    base = [f"q{rng.randint(0, 10**6)}" for _ in range(400)]
    noise = lambda n: [f"n{rng.randint(0, 10**9)}" for _ in range(n)]
    texts = [" ".join(noise(20) + base[i : i + n] + noise(20)) for i, n in [(0, 400), (10, 60), (40, 55), (60, 49), (80, 90), (85, 51), (100, 70), (130, 50), (150, 50), (151, 50), (300, 99)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    _, want = repeated_words(texts, 50)
    have = defaultdict(set)
    for r in repeats.repeated_spans(df).where("not cut").collect():
        have[r.doc_id].update(range(r.start, r.end))
    assert dict(have) == want and 3 not in want


def test_remove_keeps_one_of_each_passage(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda: " ".join(f"o{rng.randint(0, 10**9)}" for _ in range(80))
    texts = [f"{own()} {passage}\n{own()}" for _ in range(12)] + [own() for _ in range(5)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)
    out = {r.doc_id: r for r in repeats.remove(df).collect()}
    assert sum(passage in r.text for r in out.values()) == 1
    assert all(out[i].text == texts[i] for i in range(12, 17))
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert {r.doc_id for r in repeats.repeated_spans(df).collect()} == set(range(12))


def test_repeats_of_nothing(empty, documents):
    assert repeats.repeated_spans(empty).count() == 0
    out = repeats.remove(empty)
    assert out.count() == 0 and out.dtypes == documents.dtypes
    with pytest.raises(ValueError):
        repeats.repeated_spans(empty, 5, 6)


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from millrace.llm import shared

    folder = Path(shared.shared_path(spark, "x").removeprefix("file:")).parent
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    before = set(folder.iterdir())
    found = neardup.near_duplicates(df)
    assert [p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before] == ["near-duplicates"]
    assert len({r.class_id for r in found.collect()}) == 1


def test_repeats_agree_with_sql(spark):
    import duckdb

    from millrace.llm import queries

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = db.execute(queries.oracle_sql()["op4_repeats"]).fetchall()
    got = queries.op4_repeats(spark, sf).select("doc_id", "n_words", "start", "end", "cut").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50


def test_a_text_that_changes_between_readings(spark):
    """Ids stay the same, texts don't: the job fails instead of keeping what it hasn't judged."""
    from pyspark.errors import PySparkException

    anew = F.udf(lambda i: " ".join(f"{i}{x}" for x in os.urandom(20)), "string").asNondeterministic()
    docs = spark.range(50).select("id", anew("id").alias("text")).select(F.lit(1).cast("long").alias("doc_id"), "text")
    with pytest.raises(PySparkException, match="differ between two readings"):
        neardup.deduplicate(docs).collect()


def test_a_family_around_one_text(spark):
    """3,000 texts, each alike to one text and to none of the others: a node with as many links, in one class with them."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)]
    for i in range(3000):
        own = list(base)
        own[rng.randint(5, 54)] = f"x{i}"
        texts.append(" ".join(own))
    rest = [" ".join(f"y{i}_{j}" for j in range(60)) for i in range(200)]
    rows = list(enumerate([*texts[1:], *rest, texts[0]]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert len({got[i] for i in [*range(3000), 3200]}) == 1
    assert len({got[i] for i in range(3000, 3200)}) == 200
    assert neardup.deduplicate(df).count() == 201
