"""Signed changelogs: mixing relations, netting, batches, validity, states.

A row's weight in a state is the sum of its ops: bags of rows, so order inside a
batch doesn't matter and a delete may come before its insert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.chain import FkChain
from ..sources.shared import written

OP, BATCH = "op", "batch"


def data_columns(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in (OP, BATCH, "seq")]


def mixed(logs: dict[str, DataFrame]) -> DataFrame:
    """All relations in one stream: ``relation, op, batch`` and a nullable struct per relation."""
    out = None
    for name, log in logs.items():
        one = log.select(F.lit(name).alias("relation"), OP, BATCH, F.struct(*data_columns(log)).alias(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def unmixed(stream: DataFrame, name: str) -> DataFrame:
    """The changelog of one relation of a mixed stream."""
    return stream.where(F.col("relation") == name).select(f"{name}.*", OP, BATCH)


def count_updates(logs: dict[str, DataFrame]) -> DataFrame:
    """``relation, op, n``"""
    out = None
    for name, log in logs.items():
        one = log.groupBy(OP).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), OP, "n")
        out = one if out is None else out.unionByName(one)
    return out


def net_changes(log: DataFrame) -> DataFrame:
    """Changes per batch after opposite ones have cancelled: ``op`` is the sum, 0 is left out."""
    return log.groupBy(*data_columns(log), BATCH).agg(F.sum(OP).alias(OP)).where(F.col(OP) != 0)


def state_at(log: DataFrame, batch: int, before: bool = False) -> DataFrame:
    """Rows and their weights ``w`` after a batch, or before it."""
    seen = F.col(BATCH) < batch if before else F.col(BATCH) <= batch
    return log.where(seen).groupBy(*data_columns(log)).agg(F.sum(OP).alias("w")).where(F.col("w") != 0)


def assign_batches(log: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``seq`` from 1 in the given order, and ``batch = (seq - 1) div size``; all in batch 0 if size is 0 or less.

    The sorted ranges are written once with the places of their rows, so that range bounds are drawn once; numbers then
    come from the counts of the ranges before, not from one sorted task.  Equal rows get numbers in any order.
    """
    placed = log.drop(BATCH, "seq").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, n = F.shiftright("_id", 33), F.col("_id").bitwiseAND(2**33 - 1)  # as that function documents
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # a row per range
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(starts), part == F.col("_part")).withColumn("seq", F.col("_before") + n + 1)
    batch = F.floor((F.col("seq") - 1) / size).cast("long") if size > 0 else F.lit(0).cast("long")
    return out.withColumn(BATCH, batch).drop("_part", "_id", "_before")


def regrained(logs: dict[str, DataFrame], size: int, first: int) -> dict[str, DataFrame]:
    """Changelogs whose changes from batch ``first`` on are dealt anew, ``size`` to a batch (1: each change by itself; 0:
    all in one), in order of their batches; relations, deletes and keys come in order within one."""
    names = list(logs)
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    late = mixed({n: log.where(F.col(BATCH) >= first) for n, log in logs.items()})
    places = {"_b": F.col(BATCH), "_r": F.element_at(rank, F.col("relation")), "_o": F.col(OP), "_k": F.to_json(F.struct(*names))}
    dealt = assign_batches(late.withColumns(places), size, list(places)).withColumn(BATCH, F.col(BATCH) + first)
    return {n: log.where(F.col(BATCH) < first).unionByName(unmixed(dealt, n).select(*log.columns)) for n, log in logs.items()}


def running_weight(log: DataFrame, key: list[str]) -> DataFrame:
    """``key, batch, weight``: the summed ops of each key up to each batch in which it changes."""
    per = log.groupBy(*key, BATCH).agg(F.sum(OP).alias(OP))
    return per.withColumn("weight", F.sum(OP).over(Window.partitionBy(*key).orderBy(BATCH).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def validate_changelog(log: DataFrame, key: list[str]) -> DataFrame:
    """``key, batch, weight, problem``: keys deleted when absent (negative) or inserted when present (duplicate)."""
    problem = F.when(F.col("weight") < 0, "negative").when(F.col("weight") > 1, "duplicate")
    return running_weight(log, key).withColumn("problem", problem).where("problem is not null").select(*key, BATCH, "weight", "problem")


def filtered_logs(chain: FkChain, logs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The chain's filters on inserts and deletes alike, before any join or state."""
    return {r.name: r.rows(logs[r.name], (OP, BATCH)) for r in chain.rels if r.name in logs}
