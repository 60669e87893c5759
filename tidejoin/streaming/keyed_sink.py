"""A sink for streaming aggregates in update mode: only the groups that a micro-batch changed are written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import SEED, folders, put, remove


class KeyedSink:
    """The newest row of each key, in folders by micro-batch; a batch that comes again replaces its own folder.

    Every ``base_every`` batches the newest rows become one folder and those before it go, so reading doesn't grow with
    the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], base_every: int = 32):
        self.spark, self.path, self.keys, self.base_every = spark, path, keys, base_every

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/v={batch}")
        put(self.spark, f"{self.path}/schema/v={SEED}", rows.schema.json())
        if batch - self.base() >= self.base_every:
            self.rows(batch).write.mode("overwrite").parquet(f"{self.path}/bases/v={batch}")
            for v in folders(self.spark, f"{self.path}/changes"):
                if v <= batch:
                    remove(self.spark, f"{self.path}/changes/v={v}")
            for v in folders(self.spark, f"{self.path}/bases"):
                if v < batch:
                    remove(self.spark, f"{self.path}/bases/v={v}")

    def base(self) -> int:
        whole = [v for v in folders(self.spark, f"{self.path}/bases") if folders(self.spark, f"{self.path}/bases/v={v}", "_SUCCESS")]
        return max(whole, default=SEED)

    def schema(self) -> T.StructType:
        text = self.spark.read.text(f"{self.path}/schema", wholetext=True).first()[0]
        return T.StructType.fromJson(json.loads(text))

    def rows(self, upto: int | None = None) -> DataFrame:
        """The newest row of each key."""
        schema, base = self.schema(), self.base()
        after = [v for v in folders(self.spark, f"{self.path}/changes") if v > base and (upto is None or v <= upto)]
        parts = [(v, f"{self.path}/changes/v={v}") for v in after] + ([(base, f"{self.path}/bases/v={base}")] if base > SEED else [])
        if not parts:
            return self.spark.createDataFrame([], schema)
        read = None
        for kind in ("changes", "bases"):
            own = [p for _, p in parts if f"/{kind}/" in p]
            if own:
                one = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("v", T.IntegerType())])).option("basePath", f"{self.path}/{kind}").parquet(*own)
                read = one if read is None else read.unionByName(one)
        values = [c for c in schema.names if c not in self.keys]
        return read.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "v").alias("_new")).select(*self.keys, "_new.*")
