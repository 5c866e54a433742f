"""The pipeline: each stage on all its predecessor kept."""

import pytest

pytest.importorskip("numpy")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from millrace.llm import language, neardup, packing, quality, repeats  # noqa: E402
from millrace.llm.queries import learned_languages, learned_quality, vocabulary  # noqa: E402
from millrace.llm.shared import stash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "suffix-array dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1.5)).withColumn("in_0", F.lit("x"))
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = stash(corpus_pipeline.language_id(spark, docs, SF), "t")
    assert first.dtypes == docs.dtypes
    assert ids(first) == ids(language.predict(docs, learned_languages(docs)).where("not rejected"))
    second = stash(corpus_pipeline.quality_classifier(spark, first, SF), "t")
    assert second.dtypes == docs.dtypes
    assert ids(second) == ids(quality.score(first, learned_quality(first, labels)).where("predicted = 1"))
    third = stash(corpus_pipeline.near_dedup(spark, second, SF), "t")
    assert third.dtypes == docs.dtypes and ids(third) == ids(neardup.near_duplicates(second).where("first"))
    fourth = stash(corpus_pipeline.repeated_passages(spark, third, SF), "t")
    assert fourth.dtypes == docs.dtypes
    assert repeats.repeated_spans(fourth).where("not cut").count() <= repeats.repeated_spans(third).where("not cut").count()
    last = corpus_pipeline.pack(spark, fourth, SF)
    assert ids(last.select("doc_id").distinct()) == ids(fourth)
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packing.packing_digest(fourth, vocabulary("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32").collect()))


def test_pipeline_of_odd_rows(documents, spark):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, SF), "t")
        assert docs.dtypes == documents.dtypes
    assert corpus_pipeline.pack(spark, docs, SF).count() > 0


def test_pipeline_of_nothing(empty, spark):
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, SF), "t")
    assert corpus_pipeline.pack(spark, docs, SF).count() == 0
