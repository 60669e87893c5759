"""What the operators share: reading tables, the shared folder, writing and rereading an intermediate table."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one on a local master."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="tidejoin-")
    return _own


_own: str | None = None


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of ``df``, computed once and read again from the shared folder; the plan behind them is cut.

    An executor that is lost later costs no recomputation: the table lies in shared storage.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append((out, path))
    return out


#: Tables written inside of each scratch block that is open.
_open: list[list[tuple[DataFrame, str]]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that ``written`` makes inside are deleted at the end, but for those put into the list."""
    keep: list[DataFrame] = []
    _open.append([])
    try:
        yield keep
    finally:
        made = _open.pop()
        for df, path in made:
            if any(df is k for k in keep):
                if _open:
                    _open[-1].append((df, path))
            else:
                removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of at most two numbers that may be broadcast: some 100 MB.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of a few numbers, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for those whose doc_id, or lack of one, and text are in ``gone``, a written table of ``doc_id, text_hash``.

    Only this one list is broadcast, if it is small; else both sides are dealt by doc_id.
    """
    gone = bounded(gone.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_d"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_h"]), "left_anti")


def hash_bound(n: int, most: int) -> int:
    """A bound below which about four times ``most`` of n different 64-bit hashes lie, or all of them."""
    return -(2**63) + min(2**64 - 1, 4 * most * 2**64 // max(1, n))


def least_keys(keys: DataFrame, most: int) -> list[Row]:
    """The ``most`` smallest different values of one column of hashes, on the driver.

    Values above a bound that leaves about four times as many go first, so that no task sends more than its share.
    """
    name = keys.columns[0]
    n = keys.agg(F.approx_count_distinct(name)).first()[0]
    return keys.where(F.col(name) <= hash_bound(n, most)).distinct().orderBy(name).limit(most).collect()


def release() -> None:
    """Gives freed memory back to the system: Python workers live on for the next stage, beside the executor's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; the worker's memory is given back when its task ends."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner
