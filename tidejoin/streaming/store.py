"""Versioned state of a maintained view, as append-only Parquet in shared storage.

Layout below the store's path::

    state/<relation>/v=<batch>/bucket=<b>/   weighted rows that batch changed
    deltas/v=<batch>/                        signed join rows of the batch
    view/v=<batch>/                          signed sums per group of the batch
    incoming/v=<batch>/                      the batch as it came, until its commit
    schemas/                                 the columns of each relation's state, written with the seed
    commits/v=<batch>                        written last, a file with the number of deltas: the batch counts from then on
    bases/v=<batch>/                         state and view summed up to that batch, with a file ``whole`` when complete

A batch only appends what it changed; joins and sums are linear in the weights, so
states need no rewriting.  Every ``base_every`` batches the sums so far become a base and the
changes before it go, so that what a batch reads doesn't grow with the number of batches.
``compacted`` starts a new store from the summed state.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.delta import WEIGHT
from ..operators.fk_join import partial_revenue
from ..plans.chain import FkChain

BUCKETS = 16
#: Batches after which their changes are summed up.
BASE_EVERY = 32
#: Version of the seed.
SEED = -1
#: Partition columns of a state.
_PLACE = (T.StructField("v", T.IntegerType()), T.StructField("bucket", T.IntegerType()))


# Files of a few bytes and folder names go through Spark's file system at the driver; no job reads them.
def at(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, name: str) -> None:
    fs, path = at(spark, name)
    fs.delete(path, True)


def put(spark: SparkSession, name: str, text: str) -> None:
    """Writes a file beside its place and moves it there, so that it is never seen in part."""
    fs, path = at(spark, name)
    folder, _, own = name.rpartition("/")
    _, draft = at(spark, f"{folder}/.{own}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(path, False)
    if not fs.rename(draft, path):
        raise OSError(f"can't write {name}")


def folders(spark: SparkSession, name: str, start: str = "v=") -> list:
    """The versions that a folder holds, in order; or the names that begin with something else."""
    fs, path = at(spark, name)
    if not fs.exists(path):
        return []
    found = [n for f in fs.listStatus(path) if (n := f.getPath().getName()).startswith(start)]
    return sorted(int(n[2:]) for n in found) if start == "v=" else sorted(found)


class Store:
    def __init__(self, spark: SparkSession, path: str, chain: FkChain, buckets: int = BUCKETS, base_every: int = BASE_EVERY):
        self.spark, self.path, self.chain, self.buckets, self.base_every = spark, path, chain, buckets, base_every
        self._schemas: dict[str, T.StructType] = {}
        self._view: T.StructType | None = None

    # Rows of a relation lie in the bucket of the key by which the next relation towards the fact table refers to
    # them, the fact table's rows in that of their foreign key: lines and orders of an order share a bucket number.
    def _key(self, name: str) -> str:
        rel = self.chain.rel(name)
        return rel.fk if rel is self.chain.fact else rel.key[0]

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.buckets)).cast("int")

    def seed(self, rels: dict[str, DataFrame]) -> None:
        """Starts the store from filtered tables, or from empty ones: the bulk load.  A store that has a commit is left as it is."""
        if self.names("commits"):
            return
        self.append({n: df.withColumn(WEIGHT, F.lit(1).cast("long")) for n, df in rels.items()}, SEED)
        # the view is made from what has been written: the tables are read, filtered and cast once
        self.write(partial_view(self.chain, {n: self.changes(n, SEED).drop(WEIGHT) for n in rels}), "view", SEED)
        self.commit(SEED, 0)

    def _append(self, name: str, rows: DataFrame, version: int) -> None:
        # every task writes the buckets that it has, so a large table is written by all of them
        own = rows.withColumn("bucket", self._bucket(self._key(name)))
        own.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/{name}/v={version}")

    def append(self, change: dict[str, DataFrame], version: int) -> None:
        for name, rows in change.items():
            self._append(name, rows, version)
        if version == SEED:
            # a relation's columns stay known when it has no rows
            self._schemas = {n: T.StructType([*rows.schema.fields, *_PLACE]) for n, rows in change.items()}
            self.spark.createDataFrame([(n, s.json()) for n, s in self._schemas.items()], "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{self.path}/schemas")

    def touched(self, batch: DataFrame) -> dict[str, set[int]]:
        """The relations of a mixed changelog, and the buckets that the first two of them touch: the rows that come to the
        driver are so few, whatever the batch."""
        near = [F.when(F.col("relation") == r.name, self._bucket(f"{r.name}.{self._key(r.name)}")) for r in self.chain.rels[:2] if r.name in batch.columns]
        found: dict[str, set[int]] = {}
        for name, bucket in batch.select("relation", F.coalesce(*near, F.lit(None)).alias("bucket")).distinct().collect():
            found.setdefault(name, set()).add(bucket)
        return found

    def schema(self, name: str) -> T.StructType:
        """The stored schema of a relation's state; all are read at once: a row per relation of the chain."""
        if name not in self._schemas:
            stored = self.spark.read.schema("name string, schema string").json(f"{self.path}/schemas").collect()
            self._schemas = {n: T.StructType.fromJson(json.loads(s)) for n, s in stored}
        return self._schemas[name]

    def state(self, name: str, before: int, own: list[int] | None = None) -> DataFrame:
        """Weighted rows of all versions before one; only of some buckets if those are given."""
        schema = self.schema(name)
        df = self._versions(f"state/{name}", before - 1, schema)
        if own is not None:
            df = df.where(F.col("bucket").isin(own)) if own else df.where(F.lit(False))
        return df.drop("v", "bucket")

    def changes(self, name: str, version: int) -> DataFrame:
        """The weighted rows that one version changed."""
        plain = T.StructType([f for f in self.schema(name).fields if f.name not in ("v", "bucket")])
        return self.spark.read.schema(plain).option("recursiveFileLookup", True).parquet(f"{self.path}/state/{name}/v={version}")

    def _versions(self, kind: str, upto: int, schema: T.StructType) -> DataFrame:
        """The newest base up to a version and the changes since then; ``v`` is the folder's."""
        base = max((v for v in self.names("bases") if v <= upto and self._exists(f"bases/v={v}/whole")), default=None)
        since = SEED if base is None else base + 1
        parts = [] if base is None else [f"{self.path}/bases/v={base}/{kind}/v={base}"]
        parts += [f"{self.path}/{kind}/v={v}" for v in self.names(kind) if since <= v <= upto]
        plain = T.StructType([f for f in schema.fields if f.name not in ("v", "bucket")])
        if not parts:
            return self.spark.createDataFrame([], schema)
        every = None
        for root in sorted({p.rpartition("/v=")[0] for p in parts}):
            own = [p for p in parts if p.rpartition("/v=")[0] == root]
            read = self.spark.read.schema(schema if "bucket" in schema.names else T.StructType([*plain.fields, _PLACE[0]])).option("basePath", root).parquet(*own)
            every = read if every is None else every.unionByName(read)
        return every

    def write(self, df: DataFrame, kind: str, version: int) -> DataFrame:
        path = f"{self.path}/{kind}/v={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, kind: str, version: int) -> None:
        self._delete(f"{kind}/v={version}")

    def view_changes(self, upto: int) -> DataFrame:
        """The unsummed view of all versions up to one."""
        if self._view is None:
            # the seed's own columns; after a base has taken the seed in, the base's
            first = next(f"{self.path}/{p}" for p in (f"view/v={SEED}", *[f"bases/v={v}/view/v={v}" for v in reversed(self.names("bases"))]) if self._exists(p))
            self._view = self.spark.read.parquet(first).schema
        return self._versions("view", upto, T.StructType([*self._view.fields, _PLACE[0]])).drop("v")

    def read_view(self, version: int) -> DataFrame:
        """The sums of one batch."""
        self.view_changes(SEED)
        return self.spark.read.schema(self._view).parquet(f"{self.path}/view/v={version}")

    def view(self, upto: int | None = None) -> DataFrame:
        """``group key, revenue, cnt`` after a version, or the last one."""
        df = self.view_changes(self.last() if upto is None else upto)
        return df.groupBy(self.chain.group_key).agg(F.sum("revenue").alias("revenue"), F.sum("cnt").alias("cnt"))

    def rebase(self, version: int) -> None:
        """Sums state and view up to a committed version into a base, and then drops the changes that it holds.

        A crash before the file ``whole`` leaves the changes in place; one after it leaves some that are not read any more.
        """
        for rel in self.chain.rels:
            rows = self.state(rel.name, version + 1)
            keys = [c for c in rows.columns if c != WEIGHT]
            rows = rows.groupBy(*keys).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
            rows.withColumn("bucket", self._bucket(self._key(rel.name))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/bases/v={version}/state/{rel.name}/v={version}")
        self.view(version).where("cnt <> 0 or revenue <> 0").write.mode("overwrite").parquet(f"{self.path}/bases/v={version}/view/v={version}")
        self._put(f"bases/v={version}/whole", "")
        for kind in ("view", *[f"state/{r.name}" for r in self.chain.rels]):
            for v in self.names(kind):
                if v <= version:
                    self._delete(f"{kind}/v={v}")
        for v in self.names("bases"):
            if v < version:
                self._delete(f"bases/v={v}")

    def deltas(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/deltas").where(F.col("v") <= self.last()).drop("v")

    def commit(self, version: int, n_deltas: int) -> None:
        self._put(f"commits/v={version}", str(n_deltas))

    def committed(self) -> dict[int, int]:
        """The number of deltas of each committed version."""
        return {int(r.file.rpartition("=")[2]): int(r.value) for r in self.spark.read.text(f"{self.path}/commits").select(F.col("_metadata.file_name").alias("file"), "value").collect()}

    def last(self) -> int:
        """The last version that counts."""
        return max(self.names("commits"))

    def _exists(self, name: str) -> bool:
        fs, path = at(self.spark, f"{self.path}/{name}")
        return fs.exists(path)

    def _delete(self, name: str) -> None:
        remove(self.spark, f"{self.path}/{name}")

    def _put(self, name: str, text: str) -> None:
        put(self.spark, f"{self.path}/{name}", text)

    def names(self, kind: str) -> list[int]:
        """The versions of a kind, in order."""
        return folders(self.spark, f"{self.path}/{kind}")

    def compacted(self, path: str) -> Store:
        """A new store whose seed is this one's state after its last version."""
        last, new, state = self.last(), Store(self.spark, path, self.chain, self.buckets), {}
        for rel in self.chain.rels:
            rows = self.state(rel.name, last + 1)
            columns = [c for c in rows.columns if c != WEIGHT]
            state[rel.name] = rows.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
        new.append(state, SEED)
        new.write(self.view(last).where("cnt <> 0 or revenue <> 0"), "view", SEED)
        new.commit(SEED, 0)
        if last > SEED:
            new.commit(last, 0)
        return new


def partial_view(chain: FkChain, rels: dict[str, DataFrame]) -> DataFrame:
    """The view of seed tables: groups whose chain is complete."""
    from ..operators.fk_join import with_attributes

    groups = partial_revenue(chain, rels)
    return with_attributes(chain, groups, rels).select(*groups.columns)
