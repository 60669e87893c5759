"""The keyed stateful join: restart from its checkpoint, order, repetition, hot keys."""

import pytest
from fixtures import CHAIN
from pyspark.sql import functions as F
from test_operators import as_logs, random_changes

from tidejoin.operators import replay
from tidejoin.operators.changelog import mixed
from tidejoin.streaming.keyed import KeyedJoin
from tidejoin.streaming.queries import unfiltered, write_files

PLAIN = unfiltered(CHAIN)
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "c_custkey", "c_name", "n_name"]


def bag(df):
    return {tuple(r)[:-1]: r.op for r in df.groupBy(*ROW).agg(F.sum("op").alias("op")).where("op <> 0").collect()}


@pytest.fixture(scope="module")
def logs(spark):
    return as_logs(spark, random_changes(11, 3))


def test_restart_in_the_middle(spark, logs, tmp_path):
    """Three micro-batches, a new object for each, equal the replay; the state comes from the checkpoint."""
    base = f"file://{tmp_path}"
    stream = mixed(logs)
    schema = stream.withColumn("part", F.lit(0)).schema
    for b in range(3):
        write_files([stream.where(F.col("batch") == b)], f"{base}/source", b)
        join = KeyedJoin(spark, PLAIN, f"{base}/join", schema, salts=2)
        join.run(f"{base}/source")
    want = replay.join_deltas(PLAIN, logs)
    got = join.deltas()
    assert bag(got) == bag(want) and bag(got)
    # each micro-batch emits what its changes change, as the replay has it
    for b in range(3):
        assert bag(got.where(F.col("v") == b)) == bag(want.where(F.col("batch") == b))
    # the same files again, as after a crash between the sink and the commit of the batch
    before = bag(got)
    last = spark.read.parquet(f"{base}/join/joined").where("v = 2")
    rows = last.drop("v", "_to").select(F.struct(*[c for c in last.columns if c not in ("v", "_to", "w")]).alias("row"), F.lit(None).cast("struct<n_nationkey:bigint,n_name:string>").alias("last"), "w")
    change = spark.read.parquet(f"{base}/join/last").where("v = 2").select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.struct("n_nationkey", "n_name").alias("last"), "w")
    both = rows.unionByName(change)
    again = spark.createDataFrame(both.collect(), both.schema)
    join.sink(again, 2)
    assert bag(join.deltas()) == before


def test_the_last_relation_is_not_keyed_and_only_its_folders_are_read(spark, logs, tmp_path):
    stream = mixed(logs)
    join = KeyedJoin(spark, PLAIN, f"file://{tmp_path}", stream.schema)
    source = f"file://{tmp_path}/source"
    stream.limit(0).write.parquet(source)
    plan = join.keyed(spark.readStream.schema(stream.schema).parquet(source))._jdf.queryExecution().analyzed().toString()
    assert plan.count("TransformWithStateInPySpark") == len(PLAIN.rels) - 2
