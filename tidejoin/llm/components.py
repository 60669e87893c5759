"""Connected components of an edge table by alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node with an edge to another; component is the smallest node reachable.

    Each round writes its edges to the shared folder.  Large star: a node hangs its
    larger neighbours below its smallest; small star: it hangs itself and its smaller
    neighbours there.  The rounds grow with the logarithm of the largest component.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges, seen = written(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if mark == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = mark
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        edges = written(moved.unionByName(small.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct(), "edges")
