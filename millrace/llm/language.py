"""Operator 3, language ID: compression classification.

For each language a zstandard raw-content dictionary is made of pieces of labelled texts.
A text, reduced to its words of letters in lower case, is encoded block by block and whole
with each language's dictionary; the language whose encoding is smallest is predicted, and
rejected where the next is within a margin.

Learning takes a bounded sample: of a language's different texts, in the order of their hashes,
whole ones until DICTIONARY_BYTES are full (of the last as much as still fits), DICTIONARY_DOCS
texts at most.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; ties
go to the first language in alphabetical order (and are rejected); with no learned language
all are `und`; rows that repeat are predicted each for itself, and learnt from once; a text of
any length is encoded whole, a block at a time; an empty table gives no rows; other columns
are carried if they are named, else not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DICTIONARY_DOCS, DICTIONARY_BYTES = 1000, 1 << 19
BLOCK_BYTES, LEVEL = 16384, 6
#: The next language's encoding must be larger by this share of it.
MARGIN = 0.01
#: Scores are exp(-SHARPNESS * relative excess), normalised over the languages.
SHARPNESS = 60.0
UNKNOWN = "und"
#: Languages whose sizes (a few bytes each) may go to every task; beyond it they are joined.
MOST_BROADCAST = 10_000

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def learn(labelled: DataFrame, docs_per_lang: int = DICTIONARY_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, of a sample of labelled (doc_id, text, lang).

    The sample is that of the lowest hashes of texts; a threshold by each language's number
    of rows leaves a few times the rows that are needed before any move.
    """
    rows = labelled.where("text is not null and lang is not null")
    counts = rows.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n")).limit(MOST_BROADCAST + 1).toArrow()
    sizes = labelled.sparkSession.createDataFrame(counts) if counts.num_rows <= MOST_BROADCAST else rows.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"))
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("_hash"))
    few = hashed.join(F.broadcast(sizes) if counts.num_rows <= MOST_BROADCAST else sizes, F.col("lang") == F.col("_lang"))
    few = few.where((F.col("_hash") / F.lit(2.0**64) + 0.5) * F.col("_n") <= 4 * docs_per_lang)
    # a text counts once; what is beyond a dictionary's size needn't move
    once = few.groupBy("lang", "_hash").agg(F.min(F.left("text", F.lit(dictionary_bytes))).alias("text"))
    order = Window.partitionBy("lang").orderBy("_hash")
    before = F.coalesce(F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = once.withColumn("_rank", F.row_number().over(order)).withColumn("_before", before).where((F.col("_rank") <= docs_per_lang) & (F.col("_before") < dictionary_bytes))
    texts: dict[str, list[str]] = {}
    for lang, text in taken.orderBy("lang", "_rank").select("lang", "text").collect():
        texts.setdefault(lang, []).append(text)
    # zstandard takes dictionaries of 8 bytes or more
    return {lang: b"\n".join(map(_reduced, own))[:dictionary_bytes].ljust(8) for lang, own in texts.items()}


def _reduced(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).encode()


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, lang_pred, score, lang_margin and rejected for each row."""
    langs = sorted(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast([dictionaries[x] for x in langs])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    kept = plain.drop("text")

    def classify(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        encoders = []
        for x in shared.value:
            d = zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            encoders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        for batch in batches:
            found = [_best(t, langs, encoders, margin) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                [*rest.schema.names, "lang_pred", "score", "lang_margin", "rejected"],
            )

    return plain.mapInArrow(classify, ", ".join([f"`{n}` {t}" for n, t in kept.dtypes] + ["lang_pred string, score double, lang_margin double, rejected boolean"]))


def _best(text: str | None, langs: list[str], encoders: list, margin: float) -> tuple[str, float, float, bool]:
    import math

    if not text or not langs or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0, True
    data = _reduced(text)
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = [sum(len(e.compress(b)) for b in blocks) for e in encoders]
    best = min(sizes)
    weights = [math.exp(-SHARPNESS * (s / best - 1)) for s in sizes]
    ranked = sorted(sizes)
    gap = (ranked[1] - best) / ranked[1] if len(ranked) > 1 else 1.0
    return langs[sizes.index(best)], 1 / sum(weights), gap, gap < margin
