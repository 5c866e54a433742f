"""What the corpus operators share: the shared folder, and intermediate tables in it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from millrace.session import ready, shared_path, table

__all__ = ["ready", "scratch", "shared_path", "stash", "table"]

#: Paths of the tables written since the innermost scratch() began.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def stash(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    Cuts the lineage: what reads the result doesn't compute df again, and no lost
    executor takes it away. A table that outlives its scratch() isn't deleted at its end.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    made = _SCRATCH.get()
    if made is not None and not outlives:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables stashed inside at the end: what is used later must be stashed as outliving."""
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
