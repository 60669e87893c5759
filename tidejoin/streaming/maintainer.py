"""Keeps the view up to date: one micro-batch of changes at a time, exactly once.

Out-of-order rows need no waiting list: all filtered rows are in the state, and the
delta rule's terms pick a row up when the one it refers to arrives.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import group_changes
from ..operators.changelog import OP, data_columns, filtered_logs, mixed, unmixed
from ..operators.delta import WEIGHT, delta_join
from ..operators.fk_join import with_attributes
from ..operators.topk import Reserve, order
from ..plans.chain import FkChain
from ..sources.updates import changelogs_of, update_lines
from .store import SEED, Store

#: (top rows, micro-batch, trigger)
Sink = Callable[[DataFrame, int, str], None]


class Policy(Enum):
    """When snapshots go out; the grain of a stream is the micro-batch."""

    ON_CHANGE = "on_change"
    BATCH_END = "batch_end"
    JOB_END = "job_end"


class Maintainer:
    def __init__(self, store: Store, policy: Policy = Policy.JOB_END, sink: Sink | None = None, k: int = 20):
        self.store, self.policy, self.sink, self.k = store, policy, sink, k
        self.chain: FkChain = store.chain
        self.reserve = Reserve(self.chain.group_key, k)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Applies a micro-batch of the mixed changelog; one that is committed already changes nothing.

        Nothing that a batch writes counts before its commit, and writing it again replaces it.
        """
        store, chain = self.store, self.chain
        if store.last() >= batch_id:
            return
        # a stream counts its rows as often as they are read, so they are read once
        batch = store.write(batch, "incoming", batch_id)
        touched, change = store.touched(batch), {}
        for rel in chain.rels:  # a relation that doesn't change costs no write, read or join term
            if rel.name in touched:
                rows = rel.rows(unmixed(batch, rel.name), (OP,))
                change[rel.name] = rows.groupBy(*data_columns(rows)).agg(F.sum(OP).cast("long").alias(WEIGHT)).where(F.col(WEIGHT) != 0)
        store.append(change, batch_id)
        n, deltas = Observation(), None
        if change:
            # read back where they lie: no executor keeps them in memory, and their size is known to the joins
            net = delta_join(chain, self.old_state(touched, batch_id), {name: store.changes(name, batch_id) for name in change})
            deltas = store.write(net.observe(n, F.coalesce(F.sum(F.abs(OP)), F.lit(0)).alias("n")), "deltas", batch_id)
            store.write(group_changes(chain, deltas.withColumn("batch", F.lit(batch_id)), by_batch=False), "view", batch_id)
        store.commit(batch_id, n.get["n"] if change else 0)
        store.drop("incoming", batch_id)
        if self.sink and self.policy is not Policy.JOB_END:
            before = self.ranking(batch_id - 1) if self.policy is Policy.ON_CHANGE else None
            if before != self.ranking(batch_id):
                self.sink(self.top(batch_id), batch_id, self.policy.value)
        if batch_id - max(store.names("bases"), default=SEED) >= store.base_every:
            store.rebase(batch_id)

    def old_state(self, touched: dict[str, set[int]], batch_id: int) -> dict[str, DataFrame]:
        """The state before the batch. Facts and their next relation are read in the buckets that the batch touches,
        unless a later dimension changes: that may touch any."""
        store, names = self.store, [r.name for r in self.chain.rels]
        near, own = names[:2], None
        if not set(touched) - set(near):
            own = sorted(set().union(*touched.values()))
        return {n: store.state(n, batch_id, own if n in near else None) for n in names}

    def ranking(self, version: int) -> list[tuple]:
        """The k best groups after a version and their revenues.  From the version before, only the batch's own sums are
        read; the whole view is, if the reserve is new or falls short."""
        kept = self.reserve
        if kept.version != version:
            if kept.version is not None and kept.version == version - 1:
                if version in self.store.names("view"):
                    kept.apply(self.store.read_view(version), version)
                kept.version = version
            else:
                kept.fill(self.store.view(version), version)
        found = kept.ranking()
        if found is None:
            kept.fill(self.store.view(version), version)
            found = kept.ranking() or sorted(((k, v[0]) for k, v in kept.kept.items()), key=lambda x: (-x[1], x[0]))[: self.k]
        return found

    def top(self, version: int) -> DataFrame:
        """The ranking after a version, with the dimension columns of that version."""
        rows = self.ranking(version)
        kind = {f.name: f.dataType for f in self.store.view_changes(version).schema}
        best = self.store.spark.createDataFrame(rows, T.StructType([T.StructField(n, kind[n]) for n in (self.chain.group_key, "revenue")]))
        group = next(r for r in self.chain.rels if r.key == (self.chain.group_key,))
        # of the grouping relation only the buckets of the ranked keys
        own = sorted({b for (b,) in best.select(self.store._bucket(self.chain.group_key)).collect()})
        rels = {r.name: self.current(r.name, version, own if r is group else None) for r in self.chain.rels[1:]}
        found = with_attributes(self.chain, best, rels)
        return found.select(self.chain.group_key, "revenue", *self.chain.attributes).orderBy(*order(self.chain.group_key))

    def current(self, name: str, version: int, own: list[int] | None = None) -> DataFrame:
        rows = self.store.state(name, version + 1, own)
        columns = [c for c in rows.columns if c != WEIGHT]
        return rows.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) > 0).drop(WEIGHT)

    def finish(self) -> DataFrame:
        """The final ranking; under every policy it goes to the sink once more at the end of the job."""
        last = self.store.last()
        rows = self.top(last)
        if self.sink:
            self.sink(rows, last, Policy.JOB_END.value)
        return rows


def start(spark: SparkSession, source: str, schema, maintainer: Maintainer, checkpoint: str, files_per_trigger: int | None = None, every: str | None = None) -> StreamingQuery:
    """A query over a folder of mixed changelog files that ends when all files that are there have been applied: in one
    micro-batch, or so many files at a time.  With ``every``, an interval such as "10 seconds", it goes on with the files
    that come, until it is stopped."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source).writeStream.foreachBatch(maintainer.process).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def start_updates(spark: SparkSession, path: str, chain: FkChain, maintainer: Maintainer, checkpoint: str, files_per_trigger: int | None = None, every: str | None = None) -> StreamingQuery:
    """A query over raw update files (DELETE and INSERT lines in turn) beside the tables; sets that come while it runs are
    applied when they come.  ``chain`` has the filters.  It ends with the files that are there, unless ``every`` is given."""

    wanted = {r.name: r.where for r in chain.rels}

    def sink(lines: DataFrame, batch_id: int) -> None:
        maintainer.process(mixed(filtered_logs(chain, changelogs_of(lines, wanted))), batch_id)

    out = update_lines(spark, path, files_per_trigger).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return out.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def apply(spark: SparkSession, source: str, schema, maintainer: Maintainer, checkpoint: str, files_per_trigger: int | None = None, timeout: int | None = None) -> None:
    """Runs until the files that are there have been applied, however long that takes unless a timeout in seconds is given."""
    query = start(spark, source, schema, maintainer, checkpoint, files_per_trigger)
    try:
        if query.awaitTermination(timeout) is False:
            raise TimeoutError(f"the stream took more than {timeout} seconds")
    finally:
        query.stop()


def run(spark: SparkSession, source: str, schema, maintainer: Maintainer, checkpoint: str, files_per_trigger: int | None = None, timeout: int | None = None) -> DataFrame:
    """Runs to the end and returns the final ranking."""
    apply(spark, source, schema, maintainer, checkpoint, files_per_trigger, timeout)
    return maintainer.finish()
