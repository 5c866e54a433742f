"""Operators 3, 6 and 10."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

numpy = pytest.importorskip("numpy")
pytest.importorskip("zstandard")

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import language, quality, queries, rules  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op3_language(spark, SF).join(docs, "doc_id").where("held_out and length(text) > 60").select("lang", "lang_pred", "rejected", "score").collect()
    assert len(got) > 150
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert sum(r.rejected for r in got) <= 0.05 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(documents, empty):
    dictionaries = queries.learned_languages(documents)
    got = {r.doc_id: r for r in language.predict(documents, dictionaries).where("doc_id > 1000000").collect()}
    for i in (1_000_001, 1_000_002, 1_000_003, 1_000_008):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[1_000_006].lang_pred in dictionaries
    assert language.predict(documents, dictionaries).count() == documents.count()
    assert language.predict(empty, dictionaries).count() == 0
    assert language.learn(empty) == {}
    assert {r.lang_pred for r in language.predict(documents.limit(5), {}).collect()} == {"und"}


def test_language_margin():
    import zstandard

    encoders = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for x in (b"the cat sat on the mat " * 9, b"der hund lief in den wald " * 9)]
    assert language._best("the cat sat on the mat", ["en", "de"], encoders, 0.01)[0] == "en"
    assert language._best("der hund lief in den wald", ["en", "de"], encoders, 0.01)[0] == "de"
    assert language._best("zzz", ["en", "de"], [encoders[0], encoders[0]], 0.01) == ("en", 0.5, 0.0, True)


def plain_dictionaries(rows, docs_per_lang, dictionary_bytes):
    """Of rows (text, lang): each language's different texts by their hashes, whole until the bytes are full."""
    import xxhash

    out = {}
    for lang in {r[1] for r in rows if None not in r}:
        texts = {t for t, x in rows if x == lang and t is not None}
        signed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
        held, size = [], 0
        for t in sorted(texts, key=signed)[:docs_per_lang]:
            if size >= dictionary_bytes:
                break
            held.append(t[:dictionary_bytes])
            size += len(t[:dictionary_bytes].encode())
        out[lang] = "\n".join(re.sub(r"[\W\d_]+", " ", t.lower()) for t in held).encode()[:dictionary_bytes].ljust(8)
    return out


@pytest.mark.parametrize("docs_per_lang,dictionary_bytes", [(language.DICTIONARY_DOCS, language.DICTIONARY_BYTES), (1000, 20_000), (3, 10**6)])
def test_language_against_a_plain_loop(spark, documents, rows, monkeypatch, docs_per_lang, dictionary_bytes):
    """Dictionaries, sizes, verdicts and margins of all rows, by zstandard alone."""
    import zstandard

    found = language.learn(documents, docs_per_lang, dictionary_bytes)
    want = plain_dictionaries([(r.text, r.lang) for r in rows], docs_per_lang, dictionary_bytes)
    assert found == want and len(want) > 3
    monkeypatch.setattr(language, "MOST_BROADCAST", 1)
    assert language.learn(documents, docs_per_lang, dictionary_bytes) == want
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 9), round(r.lang_margin, 9), r.rejected) for r in language.predict(documents, want).collect())
    plain = Counter()
    prepared = {}
    for x, d in want.items():
        made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=language.LEVEL)
        prepared[x] = zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_dict_id=False)
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            plain[r.doc_id, "und", 0.0, 0.0, True] += 1
            continue
        data = re.sub(r"[\W\d_]+", " ", r.text.lower()).encode()
        sizes = {x: sum(len(prepared[x].compress(data[i : i + language.BLOCK_BYTES])) for i in range(0, len(data), language.BLOCK_BYTES)) for x in sorted(want)}
        best = min(sizes, key=lambda x: (sizes[x], x))
        second = sorted(sizes.values())[1]
        score = 1 / sum(math.exp(-language.SHARPNESS * (s / sizes[best] - 1)) for s in sizes.values())
        gap = (second - sizes[best]) / second
        plain[r.doc_id, best, round(score, 9), round(gap, 9), gap < language.MARGIN] += 1
    assert got == plain


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op6_quality(spark, SF).join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    assert len(got) > 80
    assert sum(r.quality == r.predicted for r in got) >= 0.9 * len(got)
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins >= 0.95 * len(good) * len(bad)


def test_quality_of_odd_rows(spark, documents, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    ranking = queries.learned_quality(documents, labels)
    got = quality.score(documents, ranking).collect()
    assert len(got) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score(empty, ranking).count() == 0
    none = labels.limit(0)
    assert {r.predicted for r in quality.score(documents, quality.learn(documents, none)).collect()} == {1}
    assert {r.predicted for r in quality.score(documents, quality.learn(documents, labels.where("quality = 0"))).collect()} == {0}
    odd = labels.limit(30).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 7, 0)], labels.schema))
    assert quality.score(documents, quality.learn(documents, odd)).count() == documents.count()


def test_features_against_plain_python(rows):
    texts = [r.text for r in rows]
    got = quality.features(texts)
    at = {n: i for i, n in enumerate(quality.FEATURES)}
    for text, row in zip(texts, got, strict=True):
        text = text or ""
        raw, words = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text)
        n, size = max(1, len(words)), max(1, len(raw))
        threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        share = Counter(raw)
        want = {
            "log_words": math.log1p(len(words)), "shortness": 1 / math.sqrt(1 + len(words)), "word_chars": sum(map(len, words)) / n, "long_words": sum(len(w.encode()) > 20 for w in words) / n,
            "symbols": sum(c in "#*$%&|<>" for c in text) / size, "exclaim": text.count("!") / size, "digits": sum(c in "0123456789" for c in text) / size, "bars": text.count("|") / n, "stops": text.count(".") / n, "commas": text.count(",") / n,
            "lines": len(lines) / n, "repeated": len(again) / n, "same_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "distinct": len(set(words)) / n, "top_word": max(Counter(words).values(), default=0) / n,
            "bytes_used": -sum(c / len(raw) * math.log2(c / len(raw)) for c in share.values()),
        }
        for name, value in want.items():
            assert abs(row[at[name]] - value) < 1e-9, (name, text[:50])
        runs = Counter(int.from_bytes(raw[i : i + 4], "big") * 0x9E3779B1 % 2**32 >> 20 for i in range(len(raw) - 3))
        for i in range(quality.HASHED):
            hits = sum(c for place, c in runs.items() if place % quality.HASHED == i)
            assert abs(row[at[f"bytes_{i}"]] - hits / max(1, len(raw) - 3)) < 1e-9
        assert abs(sum(row[at[f"words_{i}"]] for i in range(quality.HASHED)) - bool(words)) < 1e-9


def test_bradley_terry_recovers_an_order():
    rng = numpy.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    truth = x[:, 0] * 2 - x[:, 3]
    labels = (truth > 0).astype(int)
    ranking = quality.fit(x, labels, {0: int((labels == 0).sum()), 1: int(labels.sum())}, pairs=5000)
    assert ((ranking.scores(x) >= 0.5) == labels).mean() > 0.95


def test_fit_threshold_and_score_against_plain_python():
    """Weights that minimise the pairs' logistic loss, a threshold at the labels' quantile, and scores, in plain Python."""
    rng = random.Random(3)
    rows = [[rng.gauss(0, 1 + j) for j in range(3)] for _ in range(80)]
    labels = [int(r[0] - 0.3 * r[1] + rng.gauss(0, 0.8) > 0.4) for r in rows]
    shares = {0: 300, 1: 100}
    ranking = quality.fit(numpy.array(rows), numpy.array(labels), shares, pairs=400, seed=5)
    n = len(rows)
    mean = [sum(r[j] for r in rows) / n for j in range(3)]
    scale = [math.sqrt(sum((r[j] - mean[j]) ** 2 for r in rows) / n) for j in range(3)]
    x = [[(r[j] - mean[j]) / scale[j] for j in range(3)] for r in rows]
    draw = numpy.random.default_rng(5)
    good, bad = [i for i in range(n) if labels[i]], [i for i in range(n) if not labels[i]]
    pairs = list(zip(draw.choice(good, 400).tolist(), draw.choice(bad, 400).tolist(), strict=True))
    w = [0.0] * 3
    for _ in range(3000):
        gradient = [quality.RIDGE * v for v in w]
        for a, b in pairs:
            d = [x[a][j] - x[b][j] for j in range(3)]
            p = 1 / (1 + math.exp(sum(v * y for v, y in zip(w, d, strict=True))))
            gradient = [g - v * p / 400 for g, v in zip(gradient, d, strict=True)]
        w = [v - g for v, g in zip(w, gradient, strict=True)]
        if max(map(abs, gradient)) < 1e-6:
            break
    assert all(abs(a - b) < 1e-3 for a, b in zip(w, ranking.weights, strict=True))
    raw = [sum(v * y for v, y in zip(ranking.weights, r, strict=True)) for r in x]
    # of all labelled rows 300 of 400 are of label 0; a sampled row stands for its label's share
    ranked, upto = sorted(range(n), key=lambda i: raw[i]), 0.0
    for place, i in enumerate(ranked):
        upto += (100 / len(good) if labels[i] else 300 / len(bad)) / 400
        if upto >= 0.75 - 1e-12:
            break
    assert abs(ranking.threshold - (raw[ranked[place - 1]] + raw[ranked[place]]) / 2) < 1e-9
    want = [1 / (1 + math.exp(-(v - ranking.threshold))) for v in raw]
    assert all(abs(a - b) < 1e-9 for a, b in zip(ranking.scores(numpy.array(rows)).tolist(), want, strict=True))


def test_rules_base_counts(documents, rows):
    got = defaultdict(list)
    for r in rules.judge(documents).collect():
        got[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
        assert not (r.base_failed and r.kept)
    want = defaultdict(list)
    for r in rows:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[r.doc_id].append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def kneser_ney(texts, order):
    """p(symbol | context) of a modified Kneser-Ney model of bytes, the plain way."""
    counts = {order: Counter()}
    for t in texts:
        s = [-1] * (order - 1) + list(t) + [-2]
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = {}
    for n, c in counts.items():
        ones = [sum(v == i for v in c.values()) for i in range(5)]
        y = ones[1] / (ones[1] + 2 * ones[2])
        d = [0] + [min(float(i), max(0.0, i - (i + 1) * y * ones[i + 1] / ones[i])) if ones[i] else min(float(i), 0.5 * i) for i in (1, 2, 3)]
        whole, mass = Counter(), defaultdict(float)
        for g, v in c.items():
            whole[g[:-1]] += v
            mass[g[:-1]] += d[min(v, 3)]
        tables[n] = (c, d, whole, mass)

    def p(g):
        if not g:
            return 1 / rules.SYMBOLS
        c, d, whole, mass = tables[len(g)]
        if g[:-1] not in whole:
            return p(g[1:])
        v = c.get(g, 0)
        return (v - d[min(v, 3)] if v else 0) / whole[g[:-1]] + mass[g[:-1]] / whole[g[:-1]] * p(g[1:])

    return p


def folds_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return {r.i: r.f for r in df.select("i", F.pmod(F.xxhash64("t"), F.lit(2)).alias("f")).collect()}


def bits_of(p, text, order):
    s = [-1] * (order - 1) + list((text or "").encode()) + [-2]
    return -sum(math.log2(max(rules.LEAST, p(tuple(s[i : i + order])))) for i in range(len(s) - order + 1)) / (len((text or "").encode()) + 1)


def test_perplexity_is_that_of_a_model_without_the_text(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "on and on the cat sat", "qqq zzz", "a log, a mat", None, ""]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100, texts[0], "en"), (101, texts[0], "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = folds_of(spark, texts)
    assert {0, 1} == set(fold.values())
    # nulls and empty texts have different hashes but are one text of no bytes each; each counts for itself
    models = {f: kneser_ney([(texts[i] or "").encode() for i in fold if fold[i] != f], rules.ORDER) for f in (0, 1)}
    numbers = rules.model(rules.once(df))
    # the probabilities of what may follow a context that was seen sum to 1
    for p in models.values():
        assert abs(sum(p((*b"n the", x)) for x in [*range(255), -2, -3]) - 1) < 0.02
    for found in (rules.measure(df, numbers), rules.measure(df, numbers, broadcast_entries=0)):
        got = found.collect()
        assert len(got) == len(rows)
        for r in got:
            if r.lang == "de":  # nobody else writes this language
                assert abs(r.bits - math.log2(rules.SYMBOLS)) < 1e-5
                continue
            i = r.doc_id % 100
            assert abs(r.bits - bits_of(models[fold[i]], texts[i], rules.ORDER)) < 1e-5, texts[i]


def test_copies_count_once(spark):
    rows = [(1, "a b c", "en"), (2, "a b c", "en"), (2, "x y", "en"), (3, "a b c", "de"), (4, None, "en"), (5, None, "en"), (None, "x y", None), (7, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.lang, r.text or "") for r in rules.once(df).collect())
    assert got == sorted([("en", "a b c"), ("en", "x y"), ("de", "a b c"), ("en", ""), ("und", "x y")])
    folds = folds_of(spark, ["a b c", "x y", None])
    assert {(r.text, r.fold) for r in rules.once(df).collect()} == {("a b c", folds[0]), ("x y", folds[1]), (None, folds[2])}


def plain_bands(values, below, above):
    """A language's limits, the plain way: around the shortest of all intervals with half of the values."""
    bins = sorted(math.floor(v * rules.BINS + 0.5) for v in values)
    half = -(-len(bins) // 2)
    a, b = min(((bins[i], bins[i + half - 1]) for i in range(len(bins) - half + 1)), key=lambda x: (x[1] - x[0], x[0]))
    middle, reach = (a + b) / 2, max((b - a) / 2, rules.LEAST_SPREAD * rules.BINS)
    return (middle - below * reach) / rules.BINS, (middle + above * reach) / rules.BINS


def test_verdicts_against_plain_bands(spark, documents):
    """kept by bands computed here, over distinct texts of each language that pass the base rules."""
    for below, above in ((rules.BELOW, rules.ABOVE), (1.0, 2.0)):
        texts = {}
        for r in documents.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.md5("text"), F.lit("")).alias("t")).collect():
            texts.setdefault((r.doc_id, r.lang), set()).add(r.t)
        got = rules.judge(documents, below, above).collect()
        known = [r for r in got if len(texts[r.doc_id, r.lang]) == 1]
        assert len(known) == len(got)
        by_lang = defaultdict(dict)
        for r in got:
            if not r.base_failed:
                by_lang[r.lang][next(iter(texts[r.doc_id, r.lang]))] = math.log2(r.perplexity)
        limits = {lang: plain_bands(found.values(), below, above) for lang, found in by_lang.items()}
        rejected = Counter()
        for r in got:
            low, high = limits.get(r.lang, (-1, 99))
            bits = math.log2(r.perplexity)
            near = min(abs(bits - low), abs(bits - high)) < 2 / rules.BINS
            assert near or r.kept == (not r.base_failed and low <= bits <= high)
            rejected["low" if bits < low else "high"] += not r.base_failed and not r.kept
    assert rejected["low"] and rejected["high"]


def test_rules_ways_agree_and_bands_reject(spark, documents, empty):
    key = lambda r: (r.doc_id or 0, r.n_words, r.kept, round(r.perplexity, 6))
    whole = rules.judge(documents).collect()
    assert sorted(map(key, whole)) == sorted(map(key, rules.judge(documents, broadcast_entries=0).collect()))
    passed = [r for r in whole if not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.8 * len(passed)  # some are junk, and languages have few texts here
    tight = rules.judge(documents, 0.5, 0.5).collect()
    assert 0 < sum(r.kept for r in tight) < sum(r.kept for r in whole)
    assert rules.judge(empty).count() == 0


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng, n):
    stems = ["water", "house", "green", "letter", "morning", "river", "table", "winter", "garden", "open", "the", "and", "with", "over"]
    return [" ".join(w + rng.choice(["", "s", "ing", "ed"]) + rng.choice(["", ",", str(i)]) for w in rng.choices(stems, k=150)) for i in range(n)]


def gibberish(rng, n, letters=LETTERS):
    return [" ".join("".join(rng.choices(letters, k=6)) for _ in range(150)) for _ in range(n)]


def judged(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang")
    return {r.doc_id: r for r in rules.judge(frame).collect()}


@pytest.mark.parametrize("n_junk", [3, 120])
def test_junk_is_above_the_upper_limit_however_much_there_is(spark, n_junk):
    """Beside 200 clean texts and 100 copies of one of them; all clean texts stay."""
    rng = random.Random(4)
    clean = prose(rng, 200)
    got = judged(spark, clean + gibberish(rng, n_junk) + [clean[110]] * 100)
    assert sum(got[i].kept for i in range(200)) >= 195
    for i in range(200, 200 + n_junk):
        assert not got[i].kept and not got[i].base_failed and math.log2(got[i].perplexity) > got[i].high
    assert all(got[i].kept for i in range(200 + n_junk, 300 + n_junk))


@pytest.mark.parametrize("n_junk", [3, 200])
def test_junk_among_documents(spark, n_junk):
    """Random letters, digits, hexadecimal, and prose backwards are above what the language's documents have."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(9)
    junk = gibberish(rng, n_junk) + gibberish(rng, 2, "0123456789") + gibberish(rng, 2, "0123456789abcdef")
    junk += [r.text[::-1] for r in docs.where("lang = 'en' and length(text) > 1500").orderBy("doc_id").limit(2).collect()]
    rows = spark.createDataFrame([(10**7 + i, t, "en") for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    got = rules.judge(docs.unionByName(rows)).where("lang = 'en' and not base_failed").collect()
    assert sum(r.doc_id >= 10**7 for r in got) >= n_junk + 4
    assert all(math.log2(r.perplexity) > r.high and not r.kept for r in got if r.doc_id >= 10**7)
    own = [r for r in got if r.doc_id < 10**7]
    assert sum(r.kept for r in own) >= 0.95 * len(own)


def test_perplexity_rises_with_the_share_of_junk(spark):
    rng = random.Random(6)
    clean = prose(rng, 60)
    words, own = clean[0].split(), []
    for share in (0, 5, 10, 15, 30, 60, 100):
        own.append(" ".join("".join(rng.choices(LETTERS, k=len(w))) if i * 7919 % 100 < share else w for i, w in enumerate(words)))
    got = judged(spark, clean[1:] + own)
    bits = [got[i].perplexity for i in range(59, 66)]
    assert bits == sorted(bits) and bits[-1] > 2 * bits[0]


def test_bands_of_distinct_texts(spark):
    clean = [(i, 2 + i / 1000) for i in range(200)]
    measured = lambda rows: spark.createDataFrame([("en", c, float(b), False) for c, b in rows], "lang string, content long, bits double, base_failed boolean")
    want = rules.bands(measured(clean)).first()
    assert rules.bands(measured(clean + [clean[135]] * 100)).first() == want
    assert want.low < 2 and 2.2 < want.high < 2.1 + 11 * 0.05
    far = [(1000 + i, 5 + i / 100) for i in range(150)]
    assert rules.bands(measured(clean + far)).first().high < 4
    alike = rules.bands(measured([(1, 2.0004)])).first()
    assert alike.low < 2.0 < alike.high


def test_few_languages_ways_agree(spark, monkeypatch):
    rows = [(i, f"text number {i} of some words", ["en", "de", None][i % 3]) for i in range(12)] + [(20, "text number 3 of some words", "en")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted(map(str, rules.judge(df).collect()))
    monkeypatch.setattr(rules, "BROADCAST_LANGS", 0)
    monkeypatch.setattr(rules, "BROADCAST_COPIES", 0)
    assert sorted(map(str, rules.judge(df).collect())) == want


def test_quality_learns_from_every_labelled_row(spark, rows, monkeypatch):
    """Whatever the size of blocks and however rare a label, each labelled row counts, and the threshold is one of all scores."""
    few = [r for r in rows if r.doc_id is not None][:150]
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in few], "doc_id long, text string")
    labels = spark.createDataFrame([(r.doc_id, int(i % 15 != 0)) for i, r in enumerate(few)], "doc_id long, quality int")
    for size, rare in ((4096, 256), (20, 3)):
        monkeypatch.setattr(quality, "BLOCK_ROWS", size)
        monkeypatch.setattr(quality, "RARE_ROWS", rare)
        ranking = quality.learn(docs, labels)
        x = quality.features([r.text for r in few])
        assert numpy.allclose(ranking.mean, x.mean(0), atol=1e-4)
        raw = numpy.sort(((x - ranking.mean) / ranking.scale) @ numpy.array(ranking.weights))
        n = sum(i % 15 == 0 for i in range(len(few)))
        assert abs(ranking.threshold - (raw[n - 1] + raw[n]) / 2) < 1e-3
    labelled = numpy.array([1, 0, 0, 1, 1, 1, 1])
    over, under = quality._paired(labelled)
    assert set(over) == {0, 3, 4, 5, 6} and set(under) == {1, 2} and len(over) == quality.PARTNERS * 5


def test_quality_has_no_bound_on_labelled_rows(spark):
    """One label many times the other: before, 5,000 rows of a label were learnt from."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.when(F.col("id") < 6000, "a").otherwise("bb cc dd")).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 12 == 0, 0).otherwise(1).alias("quality"))
    ranking = quality.learn(docs, labels)
    x = quality.features(["word a", "word bb cc dd"])
    assert numpy.allclose(ranking.mean, x.mean(0), atol=1e-6)


def test_counts_of_grams_are_held_within_a_bound(spark, monkeypatch):
    """One batch of texts with many times HELD_GRAMS: counts are passed on within it, and come to the same."""
    rng = random.Random(8)
    docs = spark.createDataFrame([("en", i % 2, "".join(rng.choice("abcdefgh ") for _ in range(5_000))) for i in range(40)], "lang string, fold int, text string").coalesce(1)
    want = sorted(map(tuple, rules.count_grams(docs).where("gram % 1000 = 0").collect()))
    counters = []
    monkeypatch.setattr(rules, "HELD_GRAMS", 50_000)
    own = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: counters.append(f) or own(self, f, schema))
    assert sorted(map(tuple, rules.count_grams(docs).where("gram % 1000 = 0").collect())) == want and want
    import pyarrow

    rows = docs.collect()
    table = pyarrow.table({"lang": [r.lang for r in rows], "fold": pyarrow.array([r.fold for r in rows], pyarrow.int32()), "text": [r.text for r in rows]})
    table = pyarrow.concat_tables([table] * 40)  # 1,600 texts in one batch: more than are counted at once
    passed = list(counters[0](iter(table.combine_chunks().to_batches())))
    keys = [(fold, g) for x in passed for fold, g in zip(x["fold"].to_pylist(), x["gram"].to_pylist(), strict=True)]
    assert len(keys) > len(set(keys))  # before, a batch was counted whole before anything was passed on


def _counted(texts: list[str]) -> tuple[dict[int, int], float]:
    """What a task counts of texts of a model, and the MB that it takes at most."""
    import tracemalloc

    import pyarrow

    batch = pyarrow.record_batch({"lang": ["en"] * len(texts), "fold": pyarrow.array([0] * len(texts), pyarrow.int32()), "text": texts})
    got: dict[int, int] = {}
    tasks = []

    class Docs:
        """Hands over the task of count_grams."""

        defaultParallelism, sparkSession, sparkContext = 1, property(lambda self: self), property(lambda self: self)
        first = lambda self: [1]
        agg = select = coalesce = groupBy = lambda self, *a: self
        mapInArrow = lambda self, f, schema: tasks.append(f) or self

    rules.count_grams(Docs())
    tracemalloc.start()
    try:
        for out in tasks[0](iter([batch])):
            if len(texts) < 10:
                for gram, n in zip(out.column(2).to_pylist(), out.column(3).to_pylist(), strict=True):
                    got[gram] = got.get(gram, 0) + n
        return got, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_counting_task_takes_little_memory(spark):
    """6 MB of random letters: a task took 237 MB, with n-grams and counts apart."""
    rng = numpy.random.default_rng(3)
    texts = [rng.integers(97, 123, 100_000, dtype=numpy.uint8).tobytes().decode() for _ in range(60)]
    assert _counted(texts)[1] < 180


def test_counts_beyond_what_fits_beside_a_gram(spark):
    many = 3 * rules.MOST_COUNTED
    got, _ = _counted(["a" * (many + 5), "b" * 9, "a" * 7])
    of = lambda text: int.from_bytes(text, "big")
    assert got[of(b"aaaaaa")] == many + 5 - 5 + 2 and got[of(b"bbbbbb")] == 4
    assert sum(got.values()) == many + 5 + 9 + 7 + 3  # and each text's end
