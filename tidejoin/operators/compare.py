"""Differences between two results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch


def two_way(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """``columns, side``: rows that only one side has, as often as it has them more."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def detail(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``key, status`` (same, missing, extra, changed) and both sides' values; nulls equal nulls."""
    a = left.select(*[F.col(k).alias(f"_a_{k}") for k in key], *[F.col(v).alias(f"left_{v}") for v in values], F.lit(1).alias("_a"))
    b = right.select(*[F.col(k).alias(f"_b_{k}") for k in key], *[F.col(v).alias(f"right_{v}") for v in values], F.lit(1).alias("_b"))
    on, same = F.lit(True), F.lit(True)
    for k in key:
        on = on & F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}"))
    for v in values:
        same = same & F.col(f"left_{v}").eqNullSafe(F.col(f"right_{v}"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(same, "same").otherwise("changed")
    return a.join(b, on, "full").select(*[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in key], status.alias("status"), *[f"{s}_{v}" for v in values for s in ("left", "right")])


#: Key buckets of stored results.
BUCKETS = 256


def stored_by_key(df: DataFrame, key: list[str], columns: list[str], buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """A result in folders by the hash of its key (``bucket``), to be compared by digests, once or again and again."""
    path = path or scratch(df.sparkSession, "result")
    own = df.select(*columns).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    own.write.partitionBy("bucket").parquet(path)
    return df.sparkSession.read.schema(own.schema).parquet(path)


def digests(stored: DataFrame) -> DataFrame:
    """``bucket, n, s, x``: the number of rows of each bucket and two sums of their hashes, which order doesn't change; a
    row that comes twice counts twice.  Different buckets have equal digests with a chance of 2^-128."""
    columns = [c for c in stored.columns if c != "bucket"]
    # hashes skip nulls, so that each column also says whether it is one
    marked = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    h, g = F.xxhash64(*marked), F.xxhash64(F.lit("second"), *marked)
    return stored.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.sum(g.cast("decimal(20,0)")).alias("x"))


def by_digest(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """As ``two_way``, of two results of ``stored_by_key``: only buckets whose digests differ are read again and compared."""
    a, b = digests(left), digests(right).withColumnsRenamed({c: f"_{c}" for c in ("bucket", "n", "s", "x")})
    same = reduce(lambda p, c: p & F.col(c).eqNullSafe(F.col(f"_{c}")), ("n", "s", "x"), F.lit(True))
    # as many rows as there are buckets at most
    differ = [r[0] for r in a.join(b, F.col("bucket") == F.col("_bucket"), "full").where(~same).select(F.coalesce("bucket", "_bucket")).collect()]
    own = F.col("bucket").isin(differ) if differ else F.lit(False)
    return two_way(left.where(own), right.where(own), columns)
