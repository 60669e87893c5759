"""Live tuples (their referenced chain exists), tuples that wait, counters and parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.chain import FkChain
from ..sources.shared import written
from .changelog import BATCH, OP, data_columns
from .fk_join import on_keys
from .replay import FOREVER, TASK_ROWS, row_versions, signed


def live(chain: FkChain, rels: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The live rows of each relation, from the last dimension to the fact table."""
    out = {chain.rels[-1].name: rels[chain.rels[-1].name]}
    for a, b in reversed(chain.pairs()):
        out[a.name] = rels[a.name].join(out[b.name].select(b.key[0]), on_keys(a.fk, b.key[0]), "left_semi")
    return out


def waiting(chain: FkChain, rels: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows whose referenced row is missing or waits itself; a null foreign key waits too."""
    a, b = next(p for p in chain.pairs() if p[0].name == name)
    return rels[name].join(live(chain, rels)[b.name].select(b.key[0]), on_keys(a.fk, b.key[0]), "left_anti")


def alive_counter(chain: FkChain, rels: dict[str, DataFrame], name: str) -> DataFrame:
    """``key, alive``: how many live referenced rows each row has; in a chain 0 or 1 while keys are unique."""
    a, b = next(p for p in chain.pairs() if p[0].name == name)
    children = live(chain, rels)[b.name].groupBy(F.col(b.key[0]).alias("_child")).agg(F.count("*").alias("_n"))
    return rels[name].join(children, F.col(a.fk) == F.col("_child"), "left").select(*a.key, F.coalesce("_n", F.lit(0)).alias("alive"))


def parent_pairs(df: DataFrame, fk: str, pk: str) -> DataFrame:
    """``fk, pk``: each key with the key of each row that refers to it, a row per pair; for keys of any number of parents,
    whose array would have to fit one row."""
    return df.where(F.col(fk).isNotNull()).select(fk, pk).distinct()


def parents_of(df: DataFrame, fk: str, pk: str) -> DataFrame:
    """``fk, parents, n_parents``: the keys of the rows that refer to each key."""
    return df.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.sort_array(F.collect_set(pk)).alias("parents")).withColumn("n_parents", F.size("parents"))


class Liveness:
    """Liveness kept up to date by counters: each key knows how many of its rows are live.

    A batch starts with the rows that changed.  A row's own state needs its weight and the counter of the key it refers
    to; where a key's counter crosses zero, the rows that refer to it are looked up, and only those.  Rows that become
    live or cease to be change the counter of their own key, and so on along the chain: it ends where no counter
    crosses zero.  Weights and counters are kept as their changes, in tables of the shared folder; a relation is read only if
    rows of it changed or a key that it refers to crossed zero.
    """

    def __init__(self, chain: FkChain, schemas: dict[str, DataFrame]):
        """``schemas``: a frame with the columns of each relation."""
        self.chain = chain
        self.rows: dict[str, list[DataFrame]] = {r.name: [] for r in chain.rels}
        self.counters: dict[str, list[DataFrame]] = {r.name: [] for r in chain.rels}
        self.new: dict[str, DataFrame] = {}
        self.columns = {r.name: list(schemas[r.name].columns) for r in chain.rels}
        self.reads: list[str] = []

    def _all(self, parts: list[DataFrame], keys: list[str], value: str, only: DataFrame, on: list[str]) -> DataFrame:
        """Sums of the kept changes whose ``on`` columns are in ``only``."""
        every = reduce(DataFrame.unionByName, parts)
        return every.join(only, on, "left_semi").groupBy(*keys).agg(F.sum(value).alias(value))

    def _rows(self, name: str, only: DataFrame, on: list[str]) -> DataFrame | None:
        if not self.rows[name]:
            return None
        self.reads.append(name)
        return self._all(self.rows[name], self.columns[name], "w", only, on).where("w > 0")

    def apply(self, change: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The rows of each relation that became live (``change`` +1) or ceased to be (-1) with a batch of weighted rows
        (``w``); relations without any are left out."""
        events, crossing, self.reads = {}, None, []
        for name, n in self.new.items():
            self.counters[name] = summed([*self.counters[name], n], "n")
        self.new = {}
        for i in reversed(range(len(self.chain.rels))):
            rel = self.chain.rels[i]
            columns, fk = self.columns[rel.name], rel.fk
            parts = []
            if rel.name in change:
                own = written(change[rel.name].groupBy(*columns).agg(F.sum("w").alias("d")).where("d <> 0"), "changed")
                # the same rows' weights before; eqNullSafe keeps rows with nulls
                old = self.rows[rel.name]
                both = own.select(*columns, F.lit(0).cast("long").alias("w"), "d")
                if old:
                    self.reads.append(rel.name)
                    keys = own.select(*[F.col(k).alias("_" + k) for k in rel.key]).distinct()
                    near = reduce(DataFrame.unionByName, old)
                    near = near.join(keys, reduce(lambda a, b: a & b, [near[k].eqNullSafe(keys["_" + k]) for k in rel.key]), "left_semi")
                    both = both.unionByName(near.select(*columns, "w", F.lit(0).cast("long").alias("d")))
                parts.append(both.groupBy(*columns).agg(F.sum("w").alias("w"), F.sum("d").alias("d")).where("d <> 0"))
            else:
                own = None
            if crossing is not None:
                waiting = self._rows(rel.name, crossing.select(F.col("key").alias(fk)), [fk])
                if waiting is not None:
                    parts.append(waiting.select(*columns, "w", F.lit(0).cast("long").alias("d")))
            if own is not None:
                self.rows[rel.name] = summed([*self.rows[rel.name], own.select(*columns, F.col("d").alias("w"))], "w")
            if not parts:
                crossing = None
                continue
            # a row that changed and whose key crossed zero comes twice
            rows = reduce(DataFrame.unionByName, parts).groupBy(*columns).agg(F.max("w").alias("w"), F.sum("d").alias("d"))
            before, after = F.col("w") > 0, F.col("w") + F.col("d") > 0
            if fk is not None:
                below = self.chain.rels[i + 1].name
                rows = rows.join(self._alive(below, rows.select(F.col(fk).alias("key")).distinct()), on_keys(fk, "key"), "left").drop("key")
                after = after & F.coalesce("alive", F.lit(False))
                before = before & F.coalesce("was", F.lit(False))
            found = rows.withColumn("change", after.cast("int") - before.cast("int")).where("change <> 0").select(*columns, "change")
            found = written(found, "liveness")
            if found.isEmpty():
                crossing = None
                continue
            events[rel.name] = found
            crossing = self._count(rel.name, rel.key[0], found) if i else None
        return events

    def _alive(self, name: str, keys: DataFrame) -> DataFrame:
        """``key, was, alive``: of each key that has a counter, whether it was above zero before the batch and is now."""
        parts = [c.withColumn("new", F.lit(False)) for c in self.counters[name]]
        parts += [self.new[name].withColumn("new", F.lit(True))] if name in self.new else []
        if not parts:
            return keys.select("key", F.lit(False).alias("was"), F.lit(False).alias("alive")).limit(0)
        near = reduce(DataFrame.unionByName, parts).join(keys, "key", "left_semi")
        sums = near.groupBy("key").agg(F.sum(F.when(F.col("new"), 0).otherwise(F.col("n"))).alias("n0"), F.sum("n").alias("n1"))
        return sums.select("key", (F.col("n0") > 0).alias("was"), (F.col("n1") > 0).alias("alive"))

    def _count(self, name: str, key: str, found: DataFrame) -> DataFrame | None:
        """Adds live rows to the counters of their keys; ``key`` of those that crossed zero, or None."""
        n = written(found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sum("change").cast("long").alias("n")).where("n <> 0"), "counters")
        self.new[name] = n
        crossed = written(self._alive(name, n.select("key")).where("was <> alive").select("key"), "crossing")
        return None if crossed.isEmpty() else crossed


#: Tables of changes that are kept side by side before they are summed up.
PARTS = 8


def summed(parts: list[DataFrame], value: str) -> list[DataFrame]:
    """The same changes in fewer tables, so that a plan doesn't grow with the number of batches."""
    if len(parts) < PARTS:
        return parts
    keys = [c for c in parts[0].columns if c != value]
    every = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum(value).alias(value))
    return [written(every.where(F.col(value) != 0), "summed")]


def liveness_deltas(chain: FkChain, logs: dict[str, DataFrame], last_batch: int) -> dict[str, DataFrame]:
    """``row, batch, change`` of each relation for the batches of a bounded changelog, all at once; written tables.

    The counters are the same as those of ``Liveness``, but a key's whole life comes from one sum over the batches: the
    rows that refer to it live where their own weight and its counter are above zero together.  Rows whose key never lives
    go before anything is netted, and no job is run per batch.  Relations without any change are left out.
    """
    out, alive = {}, None
    for rel in reversed(chain.rels):
        log, columns = logs[rel.name].where(F.col(BATCH).between(0, last_batch)), data_columns(logs[rel.name])
        if alive is not None:
            log = written(log.join(alive.select(F.col("_key").alias(rel.fk)), rel.fk, "left_semi").select(*columns, OP, BATCH), "near")
        # dealt by whole rows, so many to a task: a key that many rows refer to makes no large task
        v = row_versions(log.repartition(log.count() // TASK_ROWS + 1, *columns)).where("m > 0").drop("m")
        if alive is not None:
            v = v.join(alive, on_keys(rel.fk, "_key") & (F.greatest("from_batch", "_from") < F.least("to_batch", "_to")))
            v = v.withColumns({"from_batch": F.greatest("from_batch", "_from"), "to_batch": F.least("to_batch", "_to")})
        # lives that follow each other cancel where they meet
        ends = signed(v.withColumn("m", F.lit(1)), columns)
        found = written(ends.groupBy(*columns, BATCH).agg(F.sum(OP).cast("int").alias("change")).where("change <> 0").select(*columns, "change", BATCH), "liveness")
        if found.isEmpty():
            break
        out[rel.name] = found
        alive = written(key_lives(found, rel.key[0]), "alive") if rel is not chain.fact else None
    return out


def key_lives(found: DataFrame, key: str) -> DataFrame:
    """``_key, _from, _to``: the spans of batches in which the counter of a key's live rows is above zero."""
    n = found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), BATCH).agg(F.sum("change").alias("n"))
    w = Window.partitionBy("_key").orderBy(BATCH)
    sums = n.select("_key", BATCH, "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("sum"))
    crossed = sums.where((F.col("sum") > 0) != (F.col("sum") - F.col("n") > 0))
    spans = crossed.select("_key", F.col(BATCH).alias("_from"), F.coalesce(F.lead(BATCH).over(w), F.lit(FOREVER)).alias("_to"), "sum")
    return spans.where("sum > 0").drop("sum")


def liveness_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """``key, change``: +1 for keys that became live between two states, -1 for those that no longer are."""
    a, b = (df.select(*key).distinct() for df in (before, after))
    gone, come = a.join(b, key, "left_anti"), b.join(a, key, "left_anti")
    return gone.withColumn("change", F.lit(-1)).unionByName(come.withColumn("change", F.lit(1)))
