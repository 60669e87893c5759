"""Validity of a stream of changes: keys' weights are kept in Spark's state store, and only
those of the groups of changed keys are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .keyed import ROCKSDB
from .packed import GROUPS, HELD, SENT, packed_rows


def weights(sent: int = SENT, held: int = HELD) -> StatefulProcessor:
    """Rows ``key, batch, weight, problem`` for each batch after which a key is there less than never or more than once.

    The batches of a micro-batch count in their order; a batch that comes in a later micro-batch counts then.
    """
    packed = packed_rows(sent, held)

    class Weights(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.weight = packed(handle, "weight", ["key"])

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            parts: list[pd.DataFrame] = []
            for part in rows:
                parts.append(part[["key", "batch", "op"]])
                if sum(map(len, parts)) >= held:  # a key's changes of a batch become one row
                    parts = [self.summed(parts)]
            change = self.summed(parts).sort_values("batch", kind="stable")
            before = pd.Series(0, index=change["key"].unique(), dtype="int64")
            for there in self.weight.read():
                old = there[there["key"].isin(before.index)]
                before = before.add(old.groupby("key")["w"].sum(), fill_value=0).astype("int64")
            weight = change.groupby("key")["op"].cumsum() + change["key"].map(before)
            bad = change[["key", "batch"]].assign(weight=weight, problem=np.where(weight < 0, "negative", "duplicate"))[~weight.isin([0, 1])]
            self.weight.append(self.weight.net([change[["key", "op"]].rename(columns={"op": "w"})]))
            for at in range(0, len(bad), sent):
                yield bad.iloc[at : at + sent]

        def summed(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
            return pd.concat(parts).groupby(["key", "batch"], sort=False, as_index=False)["op"].sum()

        def close(self) -> None:
            pass

    return Weights()


def start(spark: SparkSession, source: str, schema: T.StructType, relation: str, key: list[str], path: str, every: str | None = None, groups: int = 4 * GROUPS) -> StreamingQuery:
    """A query over a folder of mixed changelog files that appends what breaks validity to ``path/dead``.

    It ends with the files that are there, unless ``every`` is given.
    """
    stream = spark.readStream.schema(schema).parquet(source).where(F.col("relation") == relation)
    # a null in a key is left out of its text, and so comes back as null
    text = F.to_json(F.struct(*[F.col(f"{relation}.{k}").alias(k) for k in key]))
    rows = stream.select(text.alias("key"), "op", "batch").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    kinds = T.StructType([schema[relation].dataType[k] for k in key])
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        found = rows.groupBy("part").transformWithStateInPandas(weights(), "key string, batch long, weight long, problem string", "append", "none")
        found = found.select(F.from_json("key", kinds).alias("key"), "batch", "weight", "problem").select("key.*", "batch", "weight", "problem")
        writer = found.writeStream.format("parquet").option("path", f"{path}/dead").option("checkpointLocation", f"{path}/checkpoint")
        return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
    finally:
        spark.conf.set(name, before)


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/dead")
