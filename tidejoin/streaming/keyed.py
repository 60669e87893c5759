"""The chain join with its state in Spark's own state store: a keyed stateful operator per foreign key.

A row of the changelog goes to the group of its key.  There the state holds the rows that
refer to its keys (they wait while nothing is there for them) and the rows that have them, each with its weight.
A change meets the other side's rows at once.  Keys share ``groups`` groups, whose rows are packed, thousands to a value:
a call to the state's server takes as long for one row as for all of them.  So a batch reads the groups that
it touches, and Spark keeps, snapshots and restores the state (RocksDB).

The last dimension has few keys, so it is not keyed: the rows joined so far lie in
folders of the key they refer to, and a change of the dimension reads its own folders alone.

Keys are dealt in ``salts`` parts, each with its share of the referring rows and all of
the rows referred to, so that one key with a third of all facts fills no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.changelog import OP
from ..operators.fk_join import on_keys, small
from ..plans.chain import FkChain, Rel
from .packed import GROUPS, HELD, SENT, packed_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SALTS = 4
JOINED = "referring string, referred string, w long"


def meeting_rows(sent: int = SENT, held: int = HELD) -> StatefulProcessor:
    """Joins changes of both sides of a group of keys; weights multiply, so order and repetition don't matter.

    The class is made here so that it travels whole: the process that prepares the state needs no package of ours.
    """
    packed = packed_rows(sent, held)

    class MeetingRows(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.referring, self.referred = (packed(handle, n, ["key", "row"]) for n in ("referring", "referred"))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            parts: list[pd.DataFrame] = []
            for part in rows:
                parts.append(part[["referring", "key", "row", "w"]])
                if sum(map(len, parts)) >= held:
                    yield from self.met(pd.concat(parts))
                    parts = []
            if parts:
                yield from self.met(pd.concat(parts))

        def met(self, change: pd.DataFrame) -> Iterator[pd.DataFrame]:
            side = change["referring"].to_numpy(bool)
            mine, theirs = (self.referring.net([change[s]]) for s in (side, ~side))
            # new referring rows with what is there, then new referred rows with all that refer
            if len(mine):
                for there in self.referred.read():
                    yield from self.joined(mine, there)
                self.referring.append(mine)
            if len(theirs):
                for there in self.referring.read():
                    yield from self.joined(there, theirs)
                self.referred.append(theirs)

        def joined(self, a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """Rows that share a key, of so many ``a`` at a time that few are held."""
            n = a["key"].map(b["key"].value_counts())
            a, n = a[n.notna()], n.dropna()
            if not len(a):
                return
            for _, own in a.groupby(n.cumsum().to_numpy().astype("int64") // (10 * sent)):
                out = own.merge(b, on="key")
                out = pd.DataFrame({"referring": out["row_x"], "referred": out["row_y"], "w": out["w_x"] * out["w_y"]})
                for at in range(0, len(out), sent):
                    yield out.iloc[at : at + sent]

        def close(self) -> None:
            pass

    return MeetingRows()


def _types(rel: Rel, schema: T.StructType) -> T.StructType:
    """The columns of a relation in a mixed changelog's schema."""
    own = schema[rel.name].dataType
    return T.StructType([own[c] for c in rel.columns])


class KeyedJoin:
    """The signed rows of the chain's join under a mixed changelog; ``path`` is the folder of results and checkpoint."""

    def __init__(self, spark: SparkSession, chain: FkChain, path: str, schema: T.StructType, salts: int = SALTS, groups: int = GROUPS):
        self.spark, self.chain, self.path, self.schema, self.salts, self.groups = spark, chain, path, schema, salts, groups

    def start(self, source: str, files_per_trigger: int | None = None, every: str | None = None) -> StreamingQuery:
        """A query over a folder of changelog files; it ends when those there have been applied, unless ``every`` is given."""
        reader = self.spark.readStream.schema(self.schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        out = self.keyed(reader.parquet(source))
        key, before = "spark.sql.streaming.stateStore.providerClass", self.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        self.spark.conf.set(key, ROCKSDB)  # a query keeps the settings it was started with
        try:
            writer = out.writeStream.outputMode("append").foreachBatch(self.sink).option("checkpointLocation", f"{self.path}/checkpoint")
            return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
        finally:
            self.spark.conf.set(key, before)

    def run(self, source: str) -> None:
        query = self.start(source)
        try:
            query.awaitTermination()
        finally:
            query.stop()

    def changes(self, stream: DataFrame, rel: Rel) -> DataFrame:
        return rel.rows(stream.where(F.col("relation") == rel.name).select(f"{rel.name}.*", OP), (OP,))

    def keyed(self, stream: DataFrame) -> DataFrame:
        """``row, last, w``: rows joined up to the last relation but one, and that relation's own changes."""
        rels = self.chain.rels
        left = self.changes(stream, rels[0]).select(*rels[0].columns, F.col(OP).cast("long").alias("w"))
        fields = list(_types(rels[0], self.schema).fields)
        for a, b in self.chain.pairs()[:-1]:
            both = self.referring(left, a.fk, T.StructType(fields)).unionByName(self.referred(self.changes(stream, b), b))
            both = both.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(self.groups)).cast("int"))
            met = both.groupBy("part", "salt").transformWithStateInPandas(meeting_rows(), JOINED, "append", "none")
            more = _types(b, self.schema)
            left = met.select(F.from_json("referring", T.StructType(fields)).alias("a"), F.from_json("referred", more).alias("b"), "w").select("a.*", "b.*", "w")
            fields += more.fields
        last = rels[-1]
        dimension = self.changes(stream, last).select(F.lit(None).cast(T.StructType(fields)).alias("row"), F.struct(*last.columns).alias("last"), F.col(OP).cast("long").alias("w"))
        return left.select(F.struct(*[f.name for f in fields]).alias("row"), F.lit(None).cast(_types(last, self.schema)).alias("last"), "w").unionByName(dimension)

    def referring(self, rows: DataFrame, fk: str, schema: T.StructType) -> DataFrame:
        """A row without foreign key never meets anything."""
        data = F.to_json(F.struct(*schema.names))
        return rows.where(F.col(fk).isNotNull()).select(F.col(fk).cast("string").alias("key"), F.pmod(F.xxhash64(data), F.lit(self.salts)).cast("int").alias("salt"), F.lit(True).alias("referring"), data.alias("row"), "w")

    def referred(self, rows: DataFrame, rel: Rel) -> DataFrame:
        salts = F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1)))
        return rows.select(F.col(rel.key[0]).cast("string").alias("key"), salts.alias("salt"), F.lit(False).alias("referring"), F.to_json(F.struct(*rel.columns)).alias("row"), F.col(OP).cast("long").alias("w"))

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """Adds the last dimension; a batch written again replaces itself."""
        a, last = self.chain.pairs()[-1]
        batch = batch.persist()
        try:
            rows = batch.where("row is not null").select("row.*", "w")
            rows = rows.groupBy(*[c for c in rows.columns if c != "w"]).agg(F.sum("w").alias("w")).where("w <> 0")
            change = batch.where("last is not null").select("last.*", "w")
            change = change.groupBy(*last.columns).agg(F.sum("w").alias("w")).where("w <> 0")
            rows.withColumn("_to", F.col(a.fk)).write.mode("overwrite").partitionBy("_to").parquet(f"{self.path}/joined/v={batch_id}")
            change.write.mode("overwrite").parquet(f"{self.path}/last/v={batch_id}")
            now, old = self._read("last", change, batch_id), self._read("joined", rows.withColumn("_to", F.col(a.fk)), batch_id - 1)
            new = self._read("joined", rows.withColumn("_to", F.col(a.fk)), batch_id, batch_id).drop("_to")
            out = met(new, small(now), on_keys(a.fk, last.key[0]))
            if not change.isEmpty():
                # the folder's name is the key, so that only those of changed keys are read
                out = out.unionByName(met(old, small(change), on_keys("_to", last.key[0])).drop("_to"))
            columns = [c for c in out.columns if c != "w"]
            out.groupBy(*columns).agg(F.sum("w").alias(OP)).where(F.col(OP) != 0).write.mode("overwrite").parquet(f"{self.path}/deltas/v={batch_id}")
        finally:
            batch.unpersist()

    def _read(self, kind: str, like: DataFrame, upto: int, since: int = 0) -> DataFrame:
        schema = T.StructType([*like.schema.fields, T.StructField("v", T.IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}").where(F.col("v").between(since, upto)).drop("v")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return like.limit(0)

    def deltas(self) -> DataFrame:
        """All signed join rows so far: the chain's columns, ``op``, and ``v``, the micro-batch."""
        return self.spark.read.parquet(f"{self.path}/deltas")


def met(left: DataFrame, right: DataFrame, on) -> DataFrame:
    out = left.join(right.withColumnRenamed("w", "_w"), on)
    return out.withColumn("w", F.col("w") * F.col("_w")).drop("_w")
