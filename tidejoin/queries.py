"""The registered queries of the library over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import money, revenue
from .operators import aggregate, changelog, compare, delta, fk_join, liveness, metrics, predicates, quality, replay, sinks, topk
from .plans.chain import FkChain, q10
from .sources.bucketed import bucketed
from .sources.shared import scratch, written
from .sources.tables import parquet_table, tbl_table, write_tbl
from .sources.updates import bulk, pair_lines

Query = Callable[[SparkSession, str], DataFrame]
NAMES = ("lineitem", "orders", "customer", "nation")
KEY = "c_custkey"
LAST_BATCH = 7
BUCKETS = 16
EMPTIED_LAST = 11


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: parquet_table(spark, sf_dir, n) for n in NAMES}


def rels(spark: SparkSession, sf_dir: str, chain: FkChain | None = None) -> dict[str, DataFrame]:
    return predicates.filtered(chain or q10(), tables(spark, sf_dir))


def units(c: str | Column = "revenue") -> Column:
    """Exact revenue in ten-thousandths, as a long."""
    return ((F.col(c) if isinstance(c, str) else c) * 10000).cast("long")


def in_units(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", units()).withColumnRenamed("revenue", "revenue_e4")


def seed_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The deterministic eight-batch changelog of the filtered tables: inserts spread over batches, then deletes of some
    lines, orders, customers and a nation, and re-inserts of some orders."""
    r = rels(spark, sf_dir)
    at = lambda df, op, batch: df.withColumn("op", F.lit(op)).withColumn("batch", batch.cast("long") if isinstance(batch, Column) else F.lit(batch).cast("long"))
    o, n, c, l = r["orders"], r["nation"], r["customer"], r["lineitem"]  # noqa: E741
    return {
        "lineitem": at(l, 1, (F.col("l_orderkey") + F.col("l_linenumber")) % 4).unionByName(at(l.where("l_partkey % 11 = 0"), -1, 5)),
        "orders": at(o, 1, F.col("o_orderkey") % 4).unionByName(at(o.where("o_orderkey % 13 = 0"), -1, 4 + F.col("o_orderkey") % 2)).unionByName(at(o.where("o_orderkey % 26 = 0"), 1, 6)),
        "customer": at(c, 1, 0).unionByName(at(c.where("c_custkey % 17 = 0"), -1, 6)),
        "nation": at(n, 1, 0).unionByName(at(n.where("n_nationkey = 7"), -1, 7)),
    }


# --- bulk ------------------------------------------------------------------------------------------------------------


def q10_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = q10()
    return in_units(topk.top_k(fk_join.revenue_view(chain, rels(spark, sf_dir)), KEY)).select(KEY, "c_name", "revenue_e4", "c_acctbal", "n_name").withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


def q10_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = fk_join.revenue_view(q10(), rels(spark, sf_dir)).orderBy(*topk.order(KEY))
    return in_units(view).select(KEY, "c_name", "revenue_e4", F.col("c_acctbal").cast("double").alias("c_acctbal"), "n_name")


def fk_chain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = q10()
    return fk_join.fk_join(chain, rels(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", KEY, "n_name", units(chain.measure()).alias("revenue_e4"))


def fk_chain_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join over lines and orders that are stored by order key: they meet where they lie."""
    chain, r = q10(), rels(spark, sf_dir)
    r |= {n: bucketed(r[n], k, BUCKETS) for n, k in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))}
    return fk_join.fk_join(chain, r).select("l_orderkey", "l_linenumber", "l_partkey", KEY, "n_name", units(chain.measure()).alias("revenue_e4"))


def revenue_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_units(fk_join.partial_revenue(q10(), rels(spark, sf_dir))).select(KEY, "revenue_e4", "cnt")


def revenue_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = parquet_table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_returnflag").agg(units(F.sum(revenue.exact(F.col("l_extendedprice"), F.col("l_discount")))).alias("revenue_e4"))


def revenue_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = parquet_table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_returnflag").agg(F.sum(revenue.truncated_cents(F.col("l_extendedprice"), F.col("l_discount"))).alias("revenue_cents"))


def scalar_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money and discount texts, made from prices with one digit more than a cent has, read back."""
    l = parquet_table(spark, sf_dir, "lineitem")  # noqa: E741
    price, discount = F.col("l_extendedprice").cast("string"), F.col("l_discount").cast("string")
    return l.select("l_orderkey", "l_linenumber", money.cents(F.concat(price, F.lit("9"))).alias("price_cents"), money.cents(F.concat(F.lit("-"), price, F.lit("9"))).alias("negative_cents"), money.discount_units(discount).alias("discount_units"))


def tbl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders and lines, written as pipe-delimited text, read back and joined."""
    path = scratch(spark, "tbl")
    for n in ("orders", "lineitem"):
        write_tbl(parquet_table(spark, sf_dir, n), path, n)
    o, l = (tbl_table(spark, path, n) for n in ("orders", "lineitem"))  # noqa: E741
    cents = lambda c: (F.col(c) * 100).cast("long").alias(c.partition("_")[2] + "_cents")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "l_returnflag", cents("l_extendedprice"), cents("l_discount"))


def filter_orders_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_table(spark, sf_dir, "orders").where(predicates.order_window("1996-10-01", 3)).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


def filter_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_table(spark, sf_dir, "lineitem").where(predicates.returned()).select("l_orderkey", "l_linenumber", "l_partkey")


# --- liveness and checks ---------------------------------------------------------------------------------------------


def gappy(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Filtered tables without the customers whose key 17 divides, so that some rows wait."""
    r = rels(spark, sf_dir)
    return {**r, "customer": r["customer"].where("c_custkey % 17 <> 0")}


def live_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.live(q10(), gappy(spark, sf_dir))["customer"].select(KEY, "c_name")


def live_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.live(q10(), gappy(spark, sf_dir))["orders"]


def live_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.live(q10(), gappy(spark, sf_dir))["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")


def nonlive_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.waiting(q10(), gappy(spark, sf_dir), "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


def alive_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.alive_counter(q10(), gappy(spark, sf_dir), "orders")


def parents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = liveness.parents_of(rels(spark, sf_dir)["orders"], "o_custkey", "o_orderkey")
    return found.select("o_custkey", "n_parents", F.array_join("parents", ",").alias("parents"))


def parent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.parent_pairs(rels(spark, sf_dir)["orders"], "o_custkey", "o_orderkey")


def liveness_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that became live or ceased to be with batch 6."""
    logs = seed_logs(spark, sf_dir)
    at = lambda b: liveness.live(q10(), {n: changelog.state_at(log, b).drop("w") for n, log in logs.items()})["orders"]
    return liveness.liveness_changes(at(5), at(6), ["o_orderkey"])


def liveness_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each relation that became live or ceased to be, in each of the eight batches."""
    found = liveness.liveness_deltas(q10(), seed_logs(spark, sf_dir), LAST_BATCH)
    key = {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount"), "orders": ("o_orderkey",), "customer": (KEY,), "nation": ("n_nationkey",)}
    fill = lambda n: [F.col(key[n][0]).alias("k"), *([F.col("l_linenumber"), F.col("l_partkey"), (F.col("l_extendedprice") * 100).cast("long").alias("cents"), (F.col("l_discount") * 100).cast("long").alias("pct")] if n == "lineitem" else [F.lit(None).cast(t).alias(c) for c, t in (("l_linenumber", "int"), ("l_partkey", "long"), ("cents", "long"), ("pct", "long"))])]
    return reduce(DataFrame.unionByName, [found[n].select(F.lit(n).alias("relation"), *fill(n), "batch", "change") for n in NAMES if n in found])


def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return quality.fk_orphans(t["orders"], "o_custkey", t["customer"].where("c_custkey % 17 <> 0"), KEY).select("o_orderkey", "o_custkey")


def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.pk_duplicates(parquet_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


#: Foreign keys of the driver's tables: child, column, parent, its key.
FOREIGN_KEYS = (("nation", "n_regionkey", "region", "r_regionkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"))
PRIMARY_KEYS = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))


def schema_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every primary and foreign key of the tables with the number of keys, or rows, that break it."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")}
    return quality.integrity(t, [(n, [k]) for n, k in PRIMARY_KEYS] + [("lineitem", ["l_orderkey", "l_linenumber"])], FOREIGN_KEYS)


def column_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.column_checks(parquet_table(spark, sf_dir, "customer"), [KEY, "c_name", "c_nationkey"], {"c_name": 25, "c_mktsegment": 10})


# --- changelogs ------------------------------------------------------------------------------------------------------


def changelog_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = bulk(rels(spark, sf_dir))
    return changelog.mixed(logs).select("relation", "op", "batch", F.coalesce("lineitem.l_orderkey", "orders.o_orderkey", "customer.c_custkey", "nation.n_nationkey").alias("k"))


def changelog_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.mixed(seed_logs(spark, sf_dir)).select("relation", "op", "batch", F.coalesce("lineitem.l_orderkey", "orders.o_orderkey", "customer.c_custkey", "nation.n_nationkey").alias("k"))


def changelog_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of all lines and orders and deletes of some, filtered before anything else."""
    t = tables(spark, sf_dir)
    logs = {n: df.withColumn("op", F.lit(1)).withColumn("batch", F.lit(0).cast("long")) for n, df in t.items()}
    gone = t["orders"].where("o_orderkey % 13 = 0").withColumn("op", F.lit(-1)).withColumn("batch", F.lit(1).cast("long"))
    logs["orders"] = logs["orders"].unionByName(gone)
    kept = changelog.filtered_logs(q10(), logs)
    return kept["orders"].select(F.lit("orders").alias("relation"), F.col("o_orderkey").alias("k"), "op", "batch").unionByName(kept["lineitem"].select(F.lit("lineitem").alias("relation"), F.col("l_orderkey").alias("k"), "op", "batch"))


def changelog_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update files of DELETE and INSERT lines in turn, written from the orders table and read back."""
    o = parquet_table(spark, sf_dir, "orders")
    line = lambda status: F.concat_ws("|", "o_orderkey", "o_custkey", F.lit(status), F.col("o_totalprice").cast("string"), F.col("o_orderdate").cast("string"), "o_orderpriority", F.lit("Clerk"), F.lit("0"), F.lit("note"), F.lit(""))
    path = scratch(spark, "pairs")
    # a row holds both lines of an order, so that they stay together in any file; a blank line stands between them
    pair = o.select(F.pmod("o_orderkey", F.lit(10)).alias("b"), F.concat(line("O"), F.lit("\n\n"), line("F")).alias("value"))
    pair.write.partitionBy("b").text(path)
    log = pair_lines(spark, [(f"{path}/b={b}", 4 + b) for b in range(10)], "orders", path)
    return log.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "op", "batch")


def count_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.count_updates(seed_logs(spark, sf_dir))


def assign_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, 100 to a batch."""
    return changelog.assign_batches(parquet_table(spark, sf_dir, "orders"), 100, ["o_orderkey"]).select("o_orderkey", "seq", "batch")


def net_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' changes with every order also touched, to no effect, in batch 3."""
    log = seed_logs(spark, sf_dir)["orders"]
    again = rels(spark, sf_dir)["orders"].withColumn("batch", F.lit(3).cast("long"))
    noisy = log.unionByName(again.withColumn("op", F.lit(1))).unionByName(again.withColumn("op", F.lit(-1)))
    return changelog.net_changes(noisy).select("o_orderkey", "o_custkey", "batch", F.col("op").cast("long").alias("op"))


def row_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = replay.row_versions(seed_logs(spark, sf_dir)["orders"])
    return v.select("o_orderkey", "o_custkey", "from_batch", F.when(F.col("to_batch") < replay.FOREVER, F.col("to_batch")).alias("to_batch"), "m")


def validate_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key comes more than once while it is there, as the driver's data have them."""
    return changelog.validate_changelog(seed_logs(spark, sf_dir)["lineitem"], ["l_orderkey", "l_linenumber"])


# --- deltas and views ------------------------------------------------------------------------------------------------


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.join_deltas(q10(), seed_logs(spark, sf_dir))


def delta_rows(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "l_partkey", KEY, "n_name", units(q10().measure()).alias("revenue_e4"), F.col("op").cast("long").alias("op"))


def join_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = deltas(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", KEY, "n_name", units(q10().measure()).alias("revenue_e4"), F.col("op").cast("long").alias("op"), "batch")


def delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.delta_counts(deltas(spark, sf_dir))


def delta_join_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed join rows of batch 6, in which customers go and orders come back."""
    logs = seed_logs(spark, sf_dir)
    old = {n: changelog.state_at(log, 6, before=True) for n, log in logs.items()}
    change = {n: delta.weighted(log.where("batch = 6")) for n, log in logs.items()}
    return delta_rows(delta.delta_join(q10(), old, change))


def signed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_units(replay.signed_groups(q10(), seed_logs(spark, sf_dir))).select(KEY, "revenue_e4", "cnt")


def merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards' sums, some of them negative, added up; the deltas are made once, from keys and measures."""
    d = written(replay.join_deltas(q10(), replay.narrowed(q10(), seed_logs(spark, sf_dir), ["l_extendedprice", "l_discount"])), "deltas")
    shards = [aggregate.group_changes(q10(), d.where(F.pmod("l_orderkey", F.lit(4)) == s), by_batch=False) for s in range(4)]
    return in_units(aggregate.merge_partials(KEY, *shards)).select(KEY, "revenue_e4", "cnt")


def positive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_units(aggregate.positive(aggregate.signed_aggregate(q10(), deltas(spark, sf_dir)))).select(KEY, "revenue_e4")


def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.signed_aggregate(q10(), deltas(spark, sf_dir)).agg(F.count("*").alias("n_groups"))


def running_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.running(KEY, aggregate.group_changes(q10(), deltas(spark, sf_dir)))


def running_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_units(running_view(spark, sf_dir)).select(KEY, "batch", "revenue_e4", "cnt")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.timeline(running_view(spark, sf_dir), KEY, LAST_BATCH)


def snapshots_batch_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_units(snapshots(spark, sf_dir)).select("batch", F.col("rank").cast("long").alias("rank"), KEY, "revenue_e4")


def snapshots_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking after each batch as a numbered snapshot file with a header, all read back."""
    path, shots = scratch(spark, "snapshots"), written(snapshots(spark, sf_dir), "timeline")
    for b in range(LAST_BATCH + 1):  # a batch has k rows
        sinks.write_snapshot(shots.where(F.col("batch") == b).drop("batch").orderBy("rank"), path, "BATCH_END", b)
    read = spark.read.option("header", True).option("basePath", path).csv(f"{path}/trigger=batch_end/*")
    return read.select(F.col("snapshot").cast("long").alias("batch"), F.col("rank").cast("long").alias("rank"), F.col(KEY).cast("long").alias(KEY), (F.col("revenue").cast("decimal(38,4)") * 10000).cast("long").alias("revenue_e4"))


def topk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.ranking_changes(snapshots(spark, sf_dir), KEY, LAST_BATCH)


def emptied_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The changelog with all nations gone in batch 8, back in batch 10, and a batch of no effect on either side."""
    logs = seed_logs(spark, sf_dir)
    left = rels(spark, sf_dir)["nation"].where("n_nationkey <> 7")
    again = [left.withColumn("op", F.lit(op)).withColumn("batch", F.lit(b).cast("long")) for op, b in ((-1, 8), (1, 10))]
    return {**logs, "nation": logs["nation"].unionByName(again[0]).unionByName(again[1])}


def emptied_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.timeline(aggregate.running(KEY, aggregate.group_changes(q10(), replay.join_deltas(q10(), emptied_logs(spark, sf_dir)))), KEY, EMPTIED_LAST)


def topk_changes_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each batch changed a ranking that becomes empty and comes back."""
    return topk.ranking_changes(emptied_snapshots(spark, sf_dir), KEY, EMPTIED_LAST)


def snapshots_on_change_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_units(topk.on_change(emptied_snapshots(spark, sf_dir), KEY, EMPTIED_LAST)).select("batch", F.col("rank").cast("long").alias("rank"), KEY, "revenue_e4")


def snapshots_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_units(topk.on_change(snapshots(spark, sf_dir), KEY, LAST_BATCH)).select("batch", F.col("rank").cast("long").alias("rank"), KEY, "revenue_e4")


# --- comparing, sinks, metrics ---------------------------------------------------------------------------------------


def two_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The maintained view and the plain one, which still has what the changelog deleted."""
    view = aggregate.signed_aggregate(q10(), deltas(spark, sf_dir))
    return in_units(view).select(KEY, "revenue_e4"), in_units(fk_join.partial_revenue(q10(), rels(spark, sf_dir))).select(KEY, "revenue_e4")


def result_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.two_way(*two_states(spark, sf_dir), [KEY, "revenue_e4"])


def result_diff_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same differences by digests of key buckets."""
    a, b = (compare.stored_by_key(df, [KEY], [KEY, "revenue_e4"]) for df in two_states(spark, sf_dir))
    return compare.by_digest(a, b, [KEY, "revenue_e4"])


def result_diff_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.detail(*two_states(spark, sf_dir), [KEY], ["revenue_e4"])


def sink_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = topk.top_k(fk_join.revenue_view(q10(), rels(spark, sf_dir)), KEY)
    return sinks.formatted(top).select(KEY, sinks.quoted("c_name").alias("c_name"), "revenue", "c_acctbal", "n_name")


def metrics_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run record per month of orders: its lines are the updates, its returned lines the deltas."""
    t = tables(spark, sf_dir)
    lines = t["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(predicates.returned()).alias("r"))
    per = t["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id")).agg(F.sum("n").alias("u"), F.sum("r").alias("d"), F.count_distinct("o_custkey").alias("g"))
    phases = F.create_map(F.lit("load"), F.col("u") * 2, F.lit("join"), F.col("u"), F.lit("aggregate"), F.col("d"), F.lit("topk"), F.col("g") % 7, F.lit("sink"), F.lit(3).cast("long"))
    return per.select("run_id", F.lit("bulk").alias("job"), (1 + F.col("g") % 2).cast("int").alias("parallelism"), F.col("u").alias("updates_total"), F.col("d").alias("join_deltas_total"), F.col("g").alias("groups_total"), F.lit(1).cast("long").alias("snapshots_total"), (F.col("u") * 3).alias("wall_time_ms"), phases.alias("phases_ms"))


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(metrics_runs(spark, sf_dir)).select("run_id", "processing_time_ms", "cluster_gap_ms", F.floor("updates_per_sec").cast("long").alias("updates_per_sec"), F.floor("join_deltas_per_sec").cast("long").alias("join_deltas_per_sec"))


def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records appended as JSON lines and read back."""
    path = scratch(spark, "metrics")
    metrics.append_json(metrics_runs(spark, sf_dir), path)
    return metrics.read_json(spark, path).select("run_id", "job", "parallelism", "updates_total", "join_deltas_total", "groups_total", "wall_time_ms", F.element_at("phases_ms", F.lit("join")).alias("join_ms"))


def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a real replay: what it read, joined, grouped and showed, counted while it ran."""
    run = metrics.Run(spark, "replay")
    with run.phase("load"):
        logs = {n: written(run.counted(log, "updates_total"), n) for n, log in seed_logs(spark, sf_dir).items()}
    with run.phase("join"):
        joined = written(run.counted(replay.join_deltas(q10(), logs), "join_deltas_total", F.abs("op")), "deltas")
    with run.phase("aggregate"):
        changes = written(aggregate.running(KEY, aggregate.group_changes(q10(), joined)), "running")
        run.counted(aggregate.signed_aggregate(q10(), joined), "groups_total").write.format("noop").mode("overwrite").save()
    with run.phase("topk"):
        shots = written(topk.timeline(changes, KEY, LAST_BATCH), "timeline")
        run.counted(shots.select("batch").distinct(), "snapshots_total").write.format("noop").mode("overwrite").save()
    return run.record().select("job", "updates_total", "join_deltas_total", "groups_total", "snapshots_total", (F.size("phases_ms") == 4).alias("phases"), (F.col("wall_time_ms") >= F.aggregate(F.map_values("phases_ms"), F.lit(0).cast("long"), lambda a, b: a + b) - 4).alias("within_wall_time"))


BATCH = (q10_top20, q10_all, fk_chain_join, fk_chain_join_bucketed, revenue_by_customer, revenue_exact, revenue_cents, scalar_money, tbl_round_trip, filter_orders_window, filter_returned, live_customers, live_orders, live_lineitems, nonlive_lineitems, alive_counter, parents_of, parent_pairs, liveness_changes, liveness_deltas, fk_orphans, pk_duplicates, schema_integrity, column_checks, changelog_bulk, changelog_mixed, changelog_filtered, changelog_pairs, count_updates, assign_batches, net_changes, row_versions, validate_changelog, join_deltas, delta_counts, delta_join_batch, signed_aggregate, merge_partials, positive_groups, group_count, running_revenue, snapshots_batch_end, snapshots_written, topk_changes, snapshots_on_change, topk_changes_emptied, snapshots_on_change_emptied, result_diff, result_diff_digest, result_diff_detail, sink_csv_rows, metrics_summary, metrics_json, run_record)


def queries() -> dict[str, Query]:
    from .streaming import queries as streams

    return {f.__name__: f for f in BATCH} | streams.queries()
