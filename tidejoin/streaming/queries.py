"""Registered queries that run a stream to its end over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changelog import mixed
from ..plans.chain import FkChain, q10
from ..sources.shared import scratch
from . import validate
from .keyed import KeyedJoin
from .keyed_sink import KeyedSink
from .maintainer import Maintainer, Policy, apply, start_updates
from .store import Store

#: Changelog batches that share a folder, and so a micro-batch.
FILES = ((0, 1, 2, 3), (4, 5), (6, 7))


def unfiltered(chain: FkChain) -> FkChain:
    """The chain without filters, for changelogs that have been filtered."""
    from dataclasses import replace

    return replace(chain, rels=tuple(replace(r, where=None) for r in chain.rels))


def write_files(parts: list[DataFrame], path: str, first: int = 0) -> None:
    """A folder per part, with as many files as Spark's tasks give."""
    for i, part in enumerate(parts, first):
        part.write.mode("append").parquet(f"{path}/part={i}")


def maintained(spark: SparkSession, parts: list[DataFrame], policy: Policy = Policy.JOB_END, sink=None, seed: dict[str, DataFrame] | None = None) -> tuple[Maintainer, DataFrame]:
    """Streams the parts into a new store, a micro-batch each, and returns the maintainer and the final ranking."""
    base, chain = scratch(spark, "stream"), unfiltered(q10())
    store = Store(spark, f"{base}/store", chain, buckets=4)
    store.seed(seed or {r.name: parts[0].select(f"{r.name}.*").limit(0) for r in chain.rels})
    maintainer = Maintainer(store, policy, sink)
    schema = parts[0].withColumn("part", F.lit(0)).schema
    for i, part in enumerate(parts):
        write_files([part], f"{base}/source", i)
        apply(spark, f"{base}/source", schema, maintainer, f"{base}/checkpoint")
    return maintainer, maintainer.finish()


def by_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    from ..queries import seed_logs

    every = mixed(seed_logs(spark, sf_dir))
    return [every.where(F.col("batch").isin(*own)) for own in FILES]


def units(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue_e4", (F.col("revenue") * 10000).cast("long")).drop("revenue")


def stream_job_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, top = maintained(spark, by_batches(spark, sf_dir))
    return units(top).select("c_custkey", "c_name", "revenue_e4", "n_name")


def stream_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk load of what batches 0 to 3 insert, then the rest as updates."""
    from ..queries import rels

    loaded = rels(spark, sf_dir)
    maintainer, _ = maintained(spark, by_batches(spark, sf_dir)[1:], seed=loaded)
    return units(maintainer.store.view().where("cnt > 0")).select("c_custkey", "revenue_e4", "cnt")


def stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines first, then orders, then the dimensions; deletes of dimensions before their inserts."""
    from ..queries import seed_logs

    every = mixed(seed_logs(spark, sf_dir))
    dimension = F.col("relation").isin("customer", "nation")
    parts = [every.where("relation = 'lineitem'"), every.where(dimension & (F.col("op") < 0)).unionByName(every.where("relation = 'orders'")), every.where(dimension & (F.col("op") > 0))]
    maintainer, _ = maintained(spark, parts)
    return units(maintainer.store.view().where("cnt > 0")).select("c_custkey", "revenue_e4", "cnt")


def stream_join_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signed join rows that the stream has emitted, summed per row."""
    maintainer, _ = maintained(spark, by_batches(spark, sf_dir))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "c_custkey", "n_name"]
    rows = maintainer.store.deltas().select(*keys, (maintainer.chain.measure() * 10000).cast("long").alias("revenue_e4"), "op")
    return rows.groupBy(*keys, "revenue_e4").agg(F.sum("op").alias("op")).where("op <> 0")


def stream_keyed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from state kept by key in Spark's state store."""
    base, parts = scratch(spark, "keyed"), by_batches(spark, sf_dir)
    join = KeyedJoin(spark, unfiltered(q10()), base, parts[0].withColumn("part", F.lit(0)).schema)
    for i, part in enumerate(parts):
        write_files([part], f"{base}/source", i)
        join.run(f"{base}/source")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "c_custkey", "n_name"]
    rows = join.deltas().select(*keys, (join.chain.measure() * 10000).cast("long").alias("revenue_e4"), "op")
    return rows.groupBy(*keys, "revenue_e4").agg(F.sum("op").alias("op")).where("op <> 0")


def stream_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums kept by a streaming aggregation over the signed deltas that the join stream has emitted."""
    maintainer, _ = maintained(spark, by_batches(spark, sf_dir))
    store, chain = maintainer.store, maintainer.chain
    source = f"{store.path}/deltas"
    deltas = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    sums = deltas.groupBy(chain.group_key).agg(F.sum(chain.measure() * F.col("op")).alias("revenue"), F.sum("op").alias("cnt"))
    out = scratch(spark, "sums")
    query = sums.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/sums")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return units(spark.read.parquet(f"{out}/sums")).select("c_custkey", "revenue_e4", "cnt")


def stream_revenue_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums in update mode: a micro-batch for each version of the deltas, whose changed groups alone are written."""
    maintainer, _ = maintained(spark, by_batches(spark, sf_dir))
    store, chain = maintainer.store, maintainer.chain
    out = scratch(spark, "sums")
    sink = KeyedSink(spark, f"{out}/sums", [chain.group_key])
    for v in store.names("deltas"):
        rows = spark.read.parquet(f"{store.path}/deltas/v={v}")
        rows.write.mode("append").parquet(f"{out}/source/v={v}")
        deltas = spark.readStream.schema(rows.schema).parquet(f"{out}/source/*")
        sums = deltas.groupBy(chain.group_key).agg(F.sum(chain.measure() * F.col("op")).alias("revenue"), F.sum("op").alias("cnt"))
        query = sums.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return units(sink.rows()).select("c_custkey", "revenue_e4", "cnt")


def write_update_files(spark: SparkSession, sf_dir: str, path: str, sets: list[int]) -> None:
    """Update sets of the whole tables as text: each order is deleted and comes back with the next customer, each fifth
    order's lines come back a unit dearer; a set for each remainder of the order key by 4."""
    from ..sources.tables import parquet_table

    line = lambda *c: F.concat_ws("|", *[x if isinstance(x, str) else x.cast("string") for x in c], F.lit(""))
    no = F.lit("x")
    o, l = (parquet_table(spark, sf_dir, n) for n in ("orders", "lineitem"))  # noqa: E741
    order = lambda c: line(F.col("o_orderkey"), c, F.lit("O"), F.col("o_totalprice"), F.col("o_orderdate"), no, no, F.lit("0"), no)
    item = lambda p: line(F.col("l_orderkey"), F.col("l_partkey"), F.lit("1"), F.col("l_linenumber"), F.lit("1.00"), p, F.col("l_discount"), F.lit("0.00"), F.col("l_returnflag"), no, *[F.lit("1996-11-01")] * 3, no, no, no)
    for n in sets:
        mine = o.where(F.pmod("o_orderkey", F.lit(4)) == n - 1)
        mine.select(F.concat(order(F.col("o_custkey")), F.lit("\n"), order(F.col("o_custkey") + 1))).write.text(f"{path}/orders.tbl.u{n}")
        mine = l.where((F.pmod("l_orderkey", F.lit(4)) == n - 1) & (F.pmod("l_orderkey", F.lit(5)) == 0))
        mine.select(F.concat(item(F.col("l_extendedprice")), F.lit("\n\n"), item((F.col("l_extendedprice") + 1).cast("decimal(15,2)")))).write.text(f"{path}/lineitem.tbl.u{n}")


def stream_update_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over the tables after a stream of raw update sets, two of which come when the first ones have been applied."""
    from ..queries import rels

    base, chain = scratch(spark, "update-files"), q10()
    store = Store(spark, f"{base}/store", unfiltered(chain), buckets=4)
    store.seed(rels(spark, sf_dir))
    keeper = Maintainer(store)
    for sets in ([1, 2], [3, 4]):
        write_update_files(spark, sf_dir, f"{base}/sets", sets)
        start_updates(spark, f"{base}/sets", chain, keeper, f"{base}/checkpoint").awaitTermination()
    return units(store.view().where("cnt > 0")).select("c_custkey", "revenue_e4", "cnt")


def stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key comes more than once while it is there, found as the changes come in."""
    base, parts = scratch(spark, "validate"), by_batches(spark, sf_dir)
    for i, part in enumerate(parts):
        write_files([part], f"{base}/source", i)
        validate.start(spark, f"{base}/source", part.withColumn("part", F.lit(0)).schema, "lineitem", ["l_orderkey", "l_linenumber"], base).awaitTermination()
    return validate.dead_letters(spark, base)


def stream_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking after each micro-batch, as the sink gets it; named by its last changelog batch."""
    from pyspark.sql.window import Window

    out: list[DataFrame] = []
    path = scratch(spark, "snapshots")

    def sink(rows: DataFrame, batch: int, trigger: str) -> None:
        if trigger == Policy.BATCH_END.value:
            rows.withColumn("batch", F.lit(FILES[batch][-1]).cast("long")).write.mode("overwrite").parquet(f"{path}/{batch}")
            out.append(spark.read.parquet(f"{path}/{batch}"))

    maintained(spark, by_batches(spark, sf_dir), Policy.BATCH_END, sink)
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("revenue"), "c_custkey")).cast("long")
    return units(reduce(DataFrame.unionByName, out).withColumn("rank", rank)).select("batch", "rank", "c_custkey", "revenue_e4")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (stream_job_end, stream_updates, stream_out_of_order, stream_join_deltas, stream_keyed_join, stream_revenue, stream_revenue_update, stream_update_files, stream_validate, stream_topk)}
