import random

import pytest

SF = "/root/testdata/sf0.001"
#: Columns that operators use inside.
CLASH = ("block", "number", "row", "score", "in_0", "rejected", "class_id", "pieces")


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents table, and odd rows; with columns of clashing names."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma,", "delta.\n"]) + str(rng.randint(0, 99)) for _ in range(30_000))
    odd = [
        (1_000_001, None, None, None, None), (1_000_002, "", "en", "x", 0), (1_000_003, "  \n\t ", None, "x", 5), (1_000_004, "one", "en", None, 3),
        (1_000_005, "  a  b\t\n c's  ü𝔘 , x, y.\n\nz.\nW\n", "de", "x", 1), (1_000_005, "  a  b\t\n c's  ü𝔘 , x, y.\n\nz.\nW\n", "de", "x", 1),
        (None, "no id here", "en", "x", 10), (1_000_006, long, "en", "x", len(long)), (1_000_007, "x" * 3000 + " " + "ab" * 500, "en", "x", 1), (1_000_008, "12 34 !!", "fr", "x", 1),
        (-7, "a b " * 200, "en", "x", 1),
    ]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    whole = base.unionByName(spark.createDataFrame(odd, base.schema))
    for c in CLASH:
        from pyspark.sql import functions as F

        whole = whole.withColumn(c, F.lit(c))
    return whole.repartition(5).cache()


@pytest.fixture(scope="session")
def rows(documents):
    return documents.select("doc_id", "text", "lang").collect()


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
