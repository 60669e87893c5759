"""Signed sums per group, their running values, and stored partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.chain import FkChain
from .changelog import BATCH, OP


def group_changes(chain: FkChain, deltas: DataFrame, by_batch: bool = True) -> DataFrame:
    """``group key, (batch,) revenue, cnt``: signed sums of the measure and of the copies."""
    keys = [chain.group_key, *([BATCH] if by_batch else [])]
    return deltas.groupBy(*keys).agg(F.sum(chain.measure() * F.col(OP)).alias("revenue"), F.sum(OP).alias("cnt"))


def signed_aggregate(chain: FkChain, deltas: DataFrame) -> DataFrame:
    """The view after all deltas; a group without rows is gone."""
    return group_changes(chain, deltas, by_batch=False).where("cnt > 0")


def merge_partials(group_key: str, *partials: DataFrame) -> DataFrame:
    """Partial sums of shards or of batches added up; nothing is dropped before the sum."""
    every = partials[0]
    for p in partials[1:]:
        every = every.unionByName(p)
    return every.groupBy(group_key).agg(F.sum("revenue").alias("revenue"), F.sum("cnt").alias("cnt"))


def running(group_key: str, changes: DataFrame) -> DataFrame:
    """The view's rows after each batch in which a group changes; one row per group and batch goes into the window."""
    w = Window.partitionBy(group_key).orderBy(BATCH).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.select(group_key, BATCH, F.sum("revenue").over(w).alias("revenue"), F.sum("cnt").over(w).alias("cnt"))


def positive(groups: DataFrame) -> DataFrame:
    return groups.where("revenue > 0")
