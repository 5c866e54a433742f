"""The corpus pipeline: its stages in order, each over all that the one before kept.

Defined cases. Every stage takes documents with any further columns, whatever their names,
and all but the last return the same columns. Null and empty texts have no language and go
in the first stage, as do texts without a letter; a null doc_id is carried; rows that repeat
are judged alike, and near-dedup keeps one of them (of equal ids, any one); ties of languages
go, ties at the quality threshold stay; very long texts are worked on whole, some at a time;
an empty table passes through all stages and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, neardup, packing, quality, repeats
from millrace.llm.queries import learned_languages, learned_quality, vocabulary
from millrace.llm.shared import scratch, stash, table


def _where(docs: DataFrame, judge: Callable[[DataFrame, tuple[Column, ...]], DataFrame], kept: str) -> DataFrame:
    """The rows of docs for which judge, which carries columns, says kept; with docs' columns alone."""
    plain = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), *(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)))
    carried = tuple(F.col(f"in_{i}") for i in range(len(docs.columns)))
    return judge(plain, carried).where(kept).select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is found with a margin."""
    dictionaries = learned_languages(docs)
    return _where(docs, lambda d, carry: language.predict(d, dictionaries, carry=carry), "not rejected")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score above the threshold."""
    ranking = learned_quality(docs, table(spark, sf_dir, "labels"))
    return _where(docs, lambda d, carry: quality.score(d, ranking, carry), "predicted = 1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return neardup.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all occurrences of repeated passages but the first out of the texts."""
    return repeats.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing_digest(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go when its result is written
            docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"), outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
