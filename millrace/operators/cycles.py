"""Feedback: what a step makes of rows goes in again, for a bounded number of rounds.

A Spark plan has no cycles, so each round is a plan of its own, cut off from the rounds
before by a checkpoint.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame

ROUND = "round"


def settled(df: DataFrame) -> DataFrame:
    """df, computed once: checkpointed where there is a folder for that, else persisted."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist()


def feedback(start: OrderedFrame, step: Callable[[OrderedFrame], OrderedFrame], most_rounds: int) -> OrderedFrame:
    """start's rows and what step makes of the rows of each round, until it makes none; round joins the order.

    An error if there are rows after most_rounds.
    """
    rounds, at = [], start
    for i in range(most_rounds + 1):
        at = at.with_df(settled(at.df))
        if at.df.isEmpty():
            break
        if i == most_rounds:
            raise RuntimeError(f"rows left after {most_rounds} rounds")
        rounds.append(at.df.withColumn(ROUND, F.lit(i)))
        at = step(at)
    whole = functools.reduce(DataFrame.unionByName, rounds or [start.df.limit(0).withColumn(ROUND, F.lit(0))])
    return start.within(whole, (ROUND, *start.order)).grown()
