"""Command-line jobs over a folder of tables: ``python -m tidejoin.jobs bulk|replay|stream|verify --input DIR --output DIR``.

``bulk`` writes the top 20; ``replay`` also applies the update sets beside the tables
and writes snapshots by policy; ``stream`` does so as a Structured Streaming job over a
store; ``verify`` compares the maintained view with a full recompute.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.revenue import MODES
from .operators import aggregate, changelog, compare, delta, fk_join, metrics, predicates, replay, sinks, topk
from .plans.chain import FkChain, q10
from .sources.shared import written
from .sources.tables import parquet_table, tbl_table
from .sources.updates import LOAD_ORDER, bulk, update_sets
from .streaming.maintainer import Maintainer, Policy, apply, start_updates
from .streaming.queries import unfiltered
from .streaming.store import Store

#: Columns of the result beside key and revenue; those that the tables lack are left out.
ATTRIBUTES = ("c_name", "c_acctbal", "n_name", "c_address", "c_phone", "c_comment")


def load(spark: SparkSession, path: str, layout: str) -> dict[str, DataFrame]:
    return {n: tbl_table(spark, path, n) if layout == "tbl" else parquet_table(spark, path, n) for n in LOAD_ORDER}


def chain_for(tables: dict[str, DataFrame], start_day: str, months: int, revenue_mode: str) -> FkChain:
    have = {*tables["customer"].columns, *tables["nation"].columns}
    return q10(start_day, months, tuple(a for a in ATTRIBUTES if a in have), revenue_mode)


def changelogs(spark: SparkSession, tables: dict[str, DataFrame], path: str, layout: str) -> dict[str, DataFrame]:
    """The bulk load, batches 0 to 3, and the update sets after it."""
    logs = bulk(tables)
    for name, log in update_sets(spark, path, layout=layout, tables=tables).items():
        logs[name] = logs[name].unionByName(log.select(*logs[name].columns))
    return logs


def last_batch(logs: dict[str, DataFrame]) -> int:
    return max(log.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0] for log in logs.values())


def run_bulk(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    tables = load(spark, args.input, args.format)
    chain = chain_for(tables, args.start, args.months, args.revenue)
    rels = predicates.filtered(chain, tables)
    with phase("join"):  # the sums by key are part of the join's one plan
        view = written(fk_join.revenue_view(chain, rels), "view")
    with phase("topk"):
        top = written(topk.top_k(view, chain.group_key, args.k).drop("cnt"), "top")
    with phase("sink"):
        sinks.write_csv(top.orderBy(*topk.order(chain.group_key)), f"{args.output}/top")
    return {"groups_total": view.count(), "snapshots_total": 1}


#: Milliseconds of each phase of the job that runs.
_took: dict[str, int] = {}


@contextmanager
def phase(name: str) -> Iterator[None]:
    began = time.time()
    try:
        yield
    finally:
        _took[name] = _took.get(name, 0) + int(1000 * (time.time() - began))


def run_replay(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    tables = load(spark, args.input, args.format)
    chain = chain_for(tables, args.start, args.months, args.revenue)
    with phase("load"):
        logs = changelogs(spark, tables, args.input, args.layout)
        logs = changelog.regrained(logs, args.batch_size, len(LOAD_ORDER)) if args.batch_size is not None else logs
        logs = changelog.filtered_logs(chain, logs)
        last = last_batch(logs)
    with phase("join"):
        deltas = written(replay.join_deltas(chain, logs), "deltas")
    with phase("aggregate"):
        running = written(aggregate.running(chain.group_key, aggregate.group_changes(chain, deltas)), "running")
    with phase("topk"):
        timeline = written(topk.timeline(running, chain.group_key, last, args.k), "timeline")
    shots = timeline
    if args.policy == Policy.JOB_END.value:
        shots = shots.where(F.col("batch") == last)
    elif args.policy == Policy.ON_CHANGE.value:
        shots = topk.on_change(shots, chain.group_key, last)
    with phase("sink"):
        write_replay(chain, shots, timeline.where(F.col("batch") == last), {n: changelog.state_at(log, last).drop("w") for n, log in logs.items()}, args.output)
    groups = running.groupBy(chain.group_key).agg(F.max_by("cnt", "batch").alias("cnt")).where("cnt > 0").count()
    return {"join_deltas_total": deltas.agg(F.coalesce(F.sum(F.abs("op")), F.lit(0))).first()[0], "groups_total": groups, "snapshots_total": shots.select("batch").distinct().count()}


def write_replay(chain: FkChain, shots: DataFrame, top: DataFrame, current: dict[str, DataFrame], output: str) -> None:
    """The snapshots, and the last ranking with the dimension columns of the last state."""
    sinks.formatted(shots).write.mode("overwrite").option("header", True).partitionBy("batch").csv(f"{output}/snapshots")
    final = fk_join.with_attributes(chain, top.select(chain.group_key, "revenue"), current).select(chain.group_key, "revenue", *chain.attributes).orderBy(*topk.order(chain.group_key))
    sinks.write_csv(final, f"{output}/top")


def run_stream(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    """Seeds a store from the tables, writes each update set as a folder of a stream, a micro-batch each, and runs it to its end; run again, what is committed stays as it is."""
    tables = load(spark, args.input, args.format)
    chain = chain_for(tables, args.start, args.months, args.revenue)
    plain = unfiltered(chain)
    store = Store(spark, f"{args.output}/store", plain)
    rels = predicates.filtered(chain, tables)
    with phase("load"):
        store.seed(rels)
    if args.every:
        return run_running(spark, args, chain, store)
    with phase("load"):
        updates = update_sets(spark, args.input, layout=args.layout, tables=tables)
        if args.batch_size is not None:
            updates = changelog.regrained(updates, args.batch_size, len(LOAD_ORDER))
    logs = {r.name: r.rows(updates[r.name], ("op", "batch")) if r.name in updates else rels[r.name].limit(0).withColumn("op", F.lit(1)).withColumn("batch", F.lit(0).cast("long")) for r in chain.rels}
    with phase("load"):  # all sets are read once
        mixed = written(changelog.mixed(logs), "updates")
        last = last_batch(updates)
    sent: set[tuple[int, str]] = set()

    def sink(rows: DataFrame, batch: int, trigger: str) -> None:
        with phase("sink"):
            sinks.write_snapshot(rows, f"{args.output}/snapshots", trigger, batch)
        sent.add((batch, trigger))

    keeper = Maintainer(store, Policy(args.policy), sink, args.k)
    began, sunk = time.time(), _took.get("sink", 0)
    for b in range(len(LOAD_ORDER), last + 1):
        mixed.where(F.col("batch") == b).write.mode("overwrite").parquet(f"{args.output}/source/part={b}")
        apply(spark, f"{args.output}/source", mixed.withColumn("part", F.lit(0)).schema, keeper, f"{args.output}/checkpoint")
    # one plan joins and sums; sinks run within
    _took["join"] = int(1000 * (time.time() - began)) - (_took.get("sink", 0) - sunk)
    with phase("topk"):
        top = written(keeper.finish(), "top")
    sinks.write_csv(top.orderBy(*topk.order(chain.group_key)), f"{args.output}/top")
    return {"join_deltas_total": sum(store.committed().values()), "groups_total": store.view().where("cnt > 0").count(), "snapshots_total": len(sent)}


def run_running(spark: SparkSession, args: argparse.Namespace, chain: FkChain, store: Store) -> dict[str, int]:
    """Applies raw update sets as they come, every so often, until ``--seconds`` have passed or the job is stopped."""
    sent: set[tuple[int, str]] = set()

    def sink(rows: DataFrame, batch: int, trigger: str) -> None:
        sinks.write_snapshot(rows, f"{args.output}/snapshots", trigger, batch)
        sent.add((batch, trigger))

    keeper = Maintainer(store, Policy(args.policy), sink, args.k)
    query = start_updates(spark, args.input, chain, keeper, f"{args.output}/checkpoint", every=args.every)
    with phase("join"):
        try:
            query.awaitTermination(args.seconds)
            if query.isActive:
                query.processAllAvailable()  # what has come by then counts
        finally:
            query.stop()
    with phase("topk"):
        top = written(keeper.finish(), "top")
    sinks.write_csv(top.orderBy(*topk.order(chain.group_key)), f"{args.output}/top")
    return {"join_deltas_total": sum(store.committed().values()), "groups_total": store.view().where("cnt > 0").count(), "snapshots_total": len(sent)}


def run_verify(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    """Writes the rows in which the maintained view and a full recompute differ; fails if there are any."""
    tables = load(spark, args.input, args.format)
    chain = chain_for(tables, args.start, args.months, args.revenue)
    logs = changelog.filtered_logs(chain, changelogs(spark, tables, args.input, args.layout))
    last = last_batch(logs)
    kept = aggregate.signed_aggregate(chain, replay.join_deltas(chain, logs))
    # the final state joined by its weights, which may be negative; rows are not repeated
    now = {n: changelog.state_at(log, last) for n, log in logs.items()}
    plain = delta.product_join(chain, now).groupBy(chain.group_key).agg(F.sum(chain.measure() * F.col("w")).alias("revenue"), F.sum("w").alias("cnt")).where("cnt > 0")
    differ = compare.two_way(kept, plain, [chain.group_key, "revenue"])
    differ.write.mode("overwrite").option("header", True).csv(f"{args.output}/differences")
    n = spark.read.option("header", True).csv(f"{args.output}/differences").count()
    if n:
        raise SystemExit(f"{n} rows differ, see {args.output}/differences")
    return {}


JOBS = {"bulk": run_bulk, "replay": run_replay, "stream": run_stream, "verify": run_verify}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidejoin.jobs", description=__doc__)
    p.add_argument("job", choices=JOBS)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--format", choices=("tbl", "parquet"), default="tbl")
    p.add_argument("--layout", choices=("pairs", "refresh"), default="pairs")
    p.add_argument("--policy", choices=[x.value for x in Policy], default=Policy.JOB_END.value)
    p.add_argument("--revenue", choices=list(MODES), default="exact")
    p.add_argument("--start", default="1993-10-01", help="first order day")
    p.add_argument("--months", type=int, default=3)
    p.add_argument("--batch-size", type=int, help="changes of the update sets to a batch, 1 for each by itself, 0 for all in one; by default a set is a batch")
    p.add_argument("--every", help='stream: look for new update sets at this interval, as "10 seconds", and go on until stopped; pairs layout')
    p.add_argument("--seconds", type=int, help="with --every: stop after so long, when what has come is applied")
    p.add_argument("-k", type=int, default=20)
    p.add_argument("--metrics", help="folder to which a JSON line of the run is appended")
    return p


def main(spark: SparkSession, argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.every and (args.job != "stream" or args.layout != "pairs"):
        raise SystemExit("--every is for the stream job and the pairs layout")
    _took.clear()
    began = time.time()
    totals = JOBS[args.job](spark, args)
    took = int(1000 * (time.time() - began))
    if args.metrics:
        tables = load(spark, args.input, args.format)
        updates = reduce(lambda a, b: a + b, [log.count() for log in changelogs(spark, tables, args.input, args.layout).values()])
        metrics.append_json(metrics.record(spark, job=args.job, parallelism=spark.sparkContext.defaultParallelism, updates_total=updates, wall_time_ms=took, phases_ms=dict(_took), **totals), args.metrics)


if __name__ == "__main__":
    main(SparkSession.builder.appName("tidejoin").getOrCreate())
