"""Validity of a stream: keys share groups of packed state."""

from pyspark.sql import functions as F

from tidejoin.operators.changelog import mixed, validate_changelog
from tidejoin.streaming import validate
from tidejoin.streaming.queries import write_files


def test_validity_takes_few_state_rows(spark, tmp_path):
    """3,000 keys in two groups, some twice, gone before they come, or null: a handful of state rows, and the same problems
    as over the whole changelog."""
    keys = spark.range(3000).select(F.when(F.col("id") != 5, F.col("id") + 2**53).alias("n_nationkey"), F.lit("n").alias("n_name"))
    at = lambda df, op, b: df.withColumn("op", F.lit(op)).withColumn("batch", F.lit(b).cast("long"))
    some = keys.where("n_nationkey % 7 = 0 or n_nationkey is null")
    log = at(keys, 1, 0).unionByName(at(some, 1, 1)).unionByName(at(keys.where("n_nationkey % 5 = 0"), -1, 2)).unionByName(at(some, -1, 3)).unionByName(at(keys.where("n_nationkey % 14 = 0"), -1, 4))
    every, path = mixed({"nation": log}), f"file://{tmp_path}"
    for i, own in enumerate(((0, 1), (2,), (3, 4))):
        part = every.where(F.col("batch").isin(*own))
        write_files([part], f"{path}/source", i)
        query = validate.start(spark, f"{path}/source", part.withColumn("part", F.lit(0)).schema, "nation", ["n_nationkey"], path, groups=2)
        query.awaitTermination()
        assert sum(s.numRowsTotal for p in query.recentProgress[-1:] for s in p.stateOperators) <= 20
    want = sorted(map(tuple, validate_changelog(log, ["n_nationkey"]).collect()), key=str)
    assert want and sorted(map(tuple, validate.dead_letters(spark, path).collect()), key=str) == want
