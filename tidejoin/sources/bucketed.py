"""Tables stored by the hash of a key, so that joins on it need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .shared import scratch


def bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """``df`` in ``buckets`` files by the hash of ``key``, each sorted by it; below ``path`` or a new folder of the shared
    storage.  Two tables of as many buckets join by that key without an exchange.

    The rows are dealt once before they are written, by the hash that buckets have, so each bucket is one file whatever the
    number of tasks.  Choose as many buckets as partitions that a join of the whole tables should have: a bucket is one task.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    path = path or scratch(spark, "bucketed")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
