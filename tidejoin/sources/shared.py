"""The folder that driver and executors share, and intermediate tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, or on a local master in a temporary folder."""
    global _own
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="tidejoin-")
        base = _own
    return f"{base}/{name}-{uuid.uuid4().hex}"


_own: str | None = None


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, computed once and read again; an executor lost later costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
