"""Top-K rankings: of one state, after every batch, and only when they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .changelog import BATCH
from .replay import FOREVER

#: Batches that share the candidates of a timeline.
RANGE = 16


def order(group_key: str) -> list:
    """Revenue first, equal ones by key: no tie is left open."""
    return [F.col("revenue").desc(), F.col(group_key).asc()]


def top_k(groups: DataFrame, group_key: str, k: int = 20) -> DataFrame:
    """The k groups of largest revenue, by a heap per partition and one merge."""
    return groups.orderBy(*order(group_key)).limit(k)


def timeline(running: DataFrame, group_key: str, last_batch: int, k: int = 20, span: int = RANGE) -> DataFrame:
    """``batch, rank, group key, revenue``: the top k of the positive groups after each batch from 0 on.

    ``running`` has a row per group and batch of change.  Batches are cut into ranges: a group that doesn't change
    within one can only matter there if it is among the k best such groups, so per range only those k and the changed
    groups are unfolded into batches.
    """
    life = running.withColumn("to_batch", F.coalesce(F.lead(BATCH).over(Window.partitionBy(group_key).orderBy(BATCH)), F.lit(FOREVER)))
    life = life.where("cnt > 0 and revenue > 0").withColumn("until", F.least("to_batch", F.lit(last_batch + 1)))
    parts = life.withColumn("r", F.explode(F.sequence(F.floor(F.col(BATCH) / span), F.floor((F.col("until") - 1) / span))))
    begin, end = F.greatest(BATCH, F.col("r") * span), F.least("until", (F.col("r") + 1) * span)
    parts = parts.select(group_key, "revenue", "r", begin.alias("a"), end.alias("b"))
    full = (F.col("a") == F.col("r") * span) & (F.col("b") == F.least((F.col("r") + 1) * span, F.lit(last_batch + 1)))
    best = Window.partitionBy("r").orderBy(*order(group_key))
    steady = parts.where(full).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
    each = steady.unionByName(parts.where(~full)).withColumn(BATCH, F.explode(F.sequence("a", F.col("b") - 1)))
    rank = F.row_number().over(Window.partitionBy(BATCH).orderBy(*order(group_key)))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(BATCH, "rank", group_key, "revenue")


def ranking_changes(snapshots: DataFrame, group_key: str, last_batch: int) -> DataFrame:
    """``batch, changed`` for each batch from 0 on: whether the ordered keys and revenues differ from those after the
    batch before.  A batch without snapshot rows has an empty ranking, and so has what was before the first.

    Each batch meets the one before by an equi-join on its number, so no task orders all batches.
    """
    lists = snapshots.groupBy(BATCH).agg(F.sort_array(F.collect_list(F.struct("rank", group_key, "revenue"))).alias("_top"))
    before = lists.select((F.col(BATCH) + 1).alias(BATCH), F.col("_top").alias("_before"))
    every = snapshots.sparkSession.range(last_batch + 1).select(F.col("id").alias(BATCH)).join(lists, BATCH, "left").join(before, BATCH, "left")
    return every.select(BATCH, (~F.col("_top").eqNullSafe(F.col("_before"))).alias("changed"))


def on_change(snapshots: DataFrame, group_key: str, last_batch: int) -> DataFrame:
    """The snapshots of the batches that changed the ranking; one that became empty has no rows to show."""
    return snapshots.join(ranking_changes(snapshots, group_key, last_batch).where("changed").select(BATCH), BATCH, "left_semi")


class Reserve:
    """The best groups of a view that changes, kept without looking at the others.

    ``spare`` groups more than the k asked for are kept with their sums.  What lies outside was below ``ceiling`` when the
    reserve was filled; each batch may have raised it by its largest gain outside.  While the k-th kept group is above that,
    the ranking is known; else ``ranking`` says so by None, and the reserve has to be filled anew.
    """

    def __init__(self, group_key: str, k: int = 20, spare: int = 100):
        self.group_key, self.k, self.spare = group_key, k, spare
        self.kept: dict[object, tuple] = {}
        self.ceiling = None
        self.version: int | None = None

    def fill(self, groups: DataFrame, version: int) -> None:
        """From a whole view (``group key, revenue, cnt``); k + spare rows and one more come to the driver."""
        best = top_k(groups.where("cnt > 0 and revenue > 0").select(self.group_key, "revenue", "cnt"), self.group_key, self.k + self.spare + 1).collect()
        self.kept = {r[0]: (r[1], r[2]) for r in best[: self.k + self.spare]}
        # without more groups only gains can lift one above zero
        self.ceiling = best[-1][1] if len(best) > self.k + self.spare else 0
        self.version = version

    def apply(self, changes: DataFrame, version: int) -> None:
        """Adds a batch's sums by group: as many rows as the reserve has, and one of the others' largest gain."""
        own = F.col(self.group_key).isin(list(self.kept)) if self.kept else F.lit(False)
        rows = changes.select(F.when(own, F.col(self.group_key)).alias("_k"), own.alias("_own"), "revenue", "cnt")
        for r in rows.groupBy("_own", "_k").agg(F.sum("revenue").alias("revenue"), F.sum("cnt").alias("cnt"), F.max("revenue").alias("most")).collect():
            if r["_own"]:
                old = self.kept[r["_k"]]
                self.kept[r["_k"]] = (old[0] + r["revenue"], old[1] + r["cnt"])
            else:
                self.ceiling += max(r["most"], 0)
        self.version = version

    def ranking(self) -> list[tuple] | None:
        """``(group, revenue)`` of the k best, or None if groups outside could be among them."""
        good = sorted(((k, v[0]) for k, v in self.kept.items() if v[1] > 0 and v[0] > 0), key=lambda x: (-x[1], x[0]))[: self.k]
        if self.ceiling > 0 and (len(good) < self.k or good[-1][1] <= self.ceiling):
            return None
        return good
