"""Units on the hand-made set, and laws of the deltas on seeded random changelogs."""

import time
import random
from collections import Counter

import pytest
from fixtures import CHAIN, frames, logs, tables
from pyspark.sql import functions as F

from tidejoin.operators import aggregate, changelog, compare, delta, fk_join, liveness, metrics, predicates, quality, replay, sinks, topk


def view(df):
    return {r.c_custkey: (r.revenue, r.cnt) for r in df.collect()}


def brute(t):
    """Groups of the hand-made tables by nested loops."""
    from datetime import date

    out = {}
    nations, customers = {n[0] for n in t["nation"]}, {c[0]: c for c in t["customer"]}
    for l in t["lineitem"]:  # noqa: E741
        for o in t["orders"]:
            c = customers.get(o[1])
            if l[0] == o[0] and l[5] == "R" and date(1996, 10, 1) <= o[2] < date(1997, 1, 1) and c and c[1] in nations:
                r, n = out.get(c[0], (0, 0))
                out[c[0]] = (r + l[3] * (1 - l[4]), n + 1)
    return out


def changes_at(chain, lg, batch):
    old = {n: changelog.state_at(x, batch, before=True) for n, x in lg.items()}
    return delta.delta_join(chain, old, {n: delta.weighted(x.where(F.col("batch") == batch)) for n, x in lg.items()})


def random_changes(seed, n_batches=5):
    """Deletes of what is there and inserts of what isn't, in any relation."""
    rng, t = random.Random(seed), tables()
    there = {n: Counter() for n in t}
    out = {n: [] for n in t}
    for b in range(n_batches):
        for n, rows in t.items():
            for row in rows:
                if there[n][row] and rng.random() < 0.25:
                    out[n].append((row, -1, b))
                    there[n][row] -= 1
                elif not there[n][row] and rng.random() < 0.5:
                    out[n].append((row, 1, b))
                    there[n][row] += 1
    return out


def as_logs(spark, changes):
    lg = logs(spark, changes)
    return changelog.filtered_logs(CHAIN, lg)


def test_bulk_view_and_edges(spark):
    rels = predicates.filtered(CHAIN, frames(spark))
    got = view(fk_join.revenue_view(CHAIN, rels))
    assert got == brute(tables())
    assert {r.o_orderkey for r in rels["orders"].collect()} & {0, 1, 2, 3} == {0, 1}
    assert view(fk_join.fk_join(CHAIN, rels).groupBy("c_custkey").agg(F.sum(CHAIN.measure()).alias("revenue"), F.count("*").alias("cnt"))) == got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_batches_and_recompute_agree(spark, seed):
    changes = random_changes(seed)
    lg = as_logs(spark, changes)
    deltas = replay.join_deltas(CHAIN, lg).cache()
    columns = [c for c in deltas.columns if c not in ("op", "batch")]
    running = aggregate.running("c_custkey", aggregate.group_changes(CHAIN, deltas))
    for b in (0, 2, 4):
        one = changes_at(CHAIN, lg, b).select(*columns, F.col("op").cast("long"))
        assert one.exceptAll(deltas.where(f"batch = {b}").select(*columns, F.col("op").cast("long"))).count() == 0
        assert deltas.where(f"batch = {b}").select(*columns, F.col("op").cast("long")).exceptAll(one).count() == 0
        state = {n: [r for r, k in Counter(r for r, op, at in changes[n] if at <= b and op > 0).items() for _ in range(k - sum(1 for x, op, at in changes[n] if x == r and op < 0 and at <= b))] for n in changes}
        last = running.where(f"batch <= {b}").groupBy("c_custkey").agg(F.max_by(F.struct("revenue", "cnt"), "batch").alias("x")).select("c_custkey", "x.*").where("cnt > 0")
        assert view(last) == brute(state)
    deltas.unpersist()


def test_everything_in_and_out_again_leaves_nothing(spark):
    changes = {n: [(r, 1, 0) for r in rows] + [(r, -1, 1 + i % 3) for i, r in enumerate(rows)] for n, rows in tables().items()}
    assert aggregate.signed_aggregate(CHAIN, replay.join_deltas(CHAIN, as_logs(spark, changes))).count() == 0


@pytest.mark.parametrize("gone", ["nation", "customer"])
def test_deleting_a_dimension_retracts_and_counts_once_again(spark, gone):
    row = next(r for r in tables()[gone] if r[0] == 1)
    changes = {n: [(r, 1, 0) for r in rows] for n, rows in tables().items()}
    changes[gone] = [*changes[gone], (row, -1, 1), (row, 1, 2)]
    deltas = replay.join_deltas(CHAIN, as_logs(spark, changes))
    lost = deltas.where("batch = 1")
    assert lost.count() > 0 and lost.where("op > 0").count() == 0
    assert view(aggregate.signed_aggregate(CHAIN, deltas)) == brute(tables())


def test_partitions_do_not_matter(spark):
    lg = as_logs(spark, random_changes(5))
    some = replay.join_deltas(CHAIN, lg).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = replay.join_deltas(CHAIN, lg).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter(some) == Counter(one)


def test_a_delete_before_its_insert_cancels_and_is_reported(spark):
    row = tables()["nation"][0]
    log = logs(spark, {"nation": [(row, -1, 0), (row, 1, 1)]})["nation"]
    assert changelog.state_at(log, 1).count() == 0
    assert [(r.batch, r.problem) for r in changelog.validate_changelog(log, ["n_nationkey"]).collect()] == [(0, "negative")]


def test_identical_rows_are_a_bag(spark):
    row = tables()["lineitem"][4]
    log = logs(spark, {"lineitem": [(row, 1, 0), (row, 1, 0), (row, -1, 1)]})["lineitem"]
    assert sorted((r.from_batch, r.to_batch, r.m) for r in replay.row_versions(log).collect()) == [(0, 1, 2), (1, replay.FOREVER, 1)]


def test_live_waiting_and_counters(spark):
    rels = predicates.filtered(CHAIN, frames(spark))
    rels["nation"] = rels["nation"].where("n_nationkey <> 2")
    live = liveness.live(CHAIN, rels)
    assert {r.c_custkey for r in live["customer"].collect()} == {c for c in range(10) if c % 5 != 2}
    assert live["lineitem"].count() + liveness.waiting(CHAIN, rels, "lineitem").count() == rels["lineitem"].count()
    assert all(r.alive == int(r.c_custkey % 5 != 2) for r in liveness.alive_counter(CHAIN, rels, "customer").collect())
    assert {r.o_custkey: r.n_parents for r in liveness.parents_of(frames(spark)["orders"], "o_custkey", "o_orderkey").collect()}[0] == 3


def test_ranking_timeline_equals_ranking_each_batch(spark):
    rng = random.Random(4)
    rows = {(g, b): (rng.randint(-9, 9), rng.randint(-1, 3)) for g in range(60) for b in range(40) if rng.random() < 0.2}
    changes = spark.createDataFrame([(g, b, r, c) for (g, b), (r, c) in rows.items()], "c_custkey long, batch long, revenue long, cnt long")
    got = topk.timeline(aggregate.running("c_custkey", changes), "c_custkey", 39, k=5, span=7).collect()
    want = []
    for b in range(40):
        now = {}
        for (g, at), (r, c) in rows.items():
            if at <= b:
                x = now.get(g, (0, 0))
                now[g] = (x[0] + r, x[1] + c)
        top = sorted(((-r, g) for g, (r, c) in now.items() if r > 0 and c > 0))[:5]
        want += [(b, i + 1, g, -r) for i, (r, g) in enumerate(top)]
    assert sorted((r.batch, r.rank, r.c_custkey, r.revenue) for r in got) == want


def test_ties_go_by_key(spark):
    df = spark.createDataFrame([(3, 5), (1, 5), (2, 9)], "c_custkey long, revenue long")
    assert [r.c_custkey for r in topk.top_k(df, "c_custkey", 2).collect()] == [2, 1]


def test_checks(spark):
    t = frames(spark)
    assert {tuple(r) for r in quality.pk_duplicates(t["lineitem"], ["l_orderkey", "l_linenumber"]).collect()} == {(4, 0, 3)}
    assert quality.fk_orphans(t["orders"], "o_custkey", t["customer"].where("c_custkey <> 4"), "c_custkey").count() == 2
    checks = {r.column: (r.n_null, r.max_length, r.ok) for r in quality.column_checks(spark.createDataFrame([("abc", None), (None, "x")], "a string, b string"), ["a"], {"b": 1}).collect()}
    assert checks == {"a": (1, None, False), "b": (1, 1, True)}


def test_comparing(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (2, 6), (3, None)], "k long, v long")
    b = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, 1)], "k long, v long")
    assert Counter(map(tuple, compare.two_way(a, b, ["k", "v"]).collect())) == Counter([(2, 6, "left"), (4, 1, "right")])
    assert {r.k: r.status for r in compare.detail(a.distinct(), b, ["k"], ["v"]).collect()} == {1: "same", 2: "same", 3: "same", 4: "extra"}


def test_batches_are_numbered_without_one_task(spark):
    df = spark.range(0, 1000).select(F.expr("(id * 7919) % 1000").alias("k"))
    got = changelog.assign_batches(df, 64, ["k"]).collect()
    assert all(r.seq == r.k + 1 and r.batch == r.k // 64 for r in got)
    assert {r.batch for r in changelog.assign_batches(df, 0, ["k"]).collect()} == {0}


def test_a_million_rows_get_each_number_once(spark):
    df = spark.range(0, 1_000_000, 1, 7).select(F.expr("(id * 7919) % 1000003").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.lit("x").alias("batch"))
    got = changelog.assign_batches(df, 1000, ["k"])
    assert got.columns == ["k", "payload", "seq", "batch"]
    assert tuple(got.agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq"), F.max("batch")).first()) == (1_000_000, 1_000_000, 1, 1_000_000, 999)
    early, late = got.where("seq <= 1000").agg(F.max("k")).first()[0], got.where("seq > 1000").agg(F.min("k")).first()[0]
    assert early < late


def test_regrained_changelogs_end_alike(spark):
    logs = as_logs(spark, random_changes(8, 5))
    late = sum(log.where("batch >= 2").count() for log in logs.values())
    for size, batches in ((1, late), (3, -(-late // 3)), (0, 1)):
        again = changelog.regrained(logs, size, 2)
        counts = {r[0]: r[1] for r in changelog.mixed(again).where("batch >= 2").groupBy("batch").count().collect()}
        assert sorted(counts) == list(range(2, 2 + batches)) and max(counts.values()) <= (size or late)
        for n, log in logs.items():
            columns = changelog.data_columns(log)
            assert Counter(map(tuple, log.select(*columns, "op").collect())) == Counter(map(tuple, again[n].select(*columns, "op").collect()))


def test_a_ranking_that_becomes_empty_has_changed(spark):
    shots = spark.createDataFrame([(0, 1, 7, 10), (0, 2, 8, 5), (2, 1, 7, 10), (2, 2, 8, 5), (3, 1, 7, 10), (3, 2, 8, 5)], "batch long, rank int, c_custkey long, revenue long")
    got = {r.batch: r.changed for r in topk.ranking_changes(shots, "c_custkey", 5).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False}
    assert {r.batch for r in topk.on_change(shots, "c_custkey", 5).collect()} == {0, 2}
    assert {r.batch: r.changed for r in topk.ranking_changes(shots.where("batch = 2"), "c_custkey", 3).collect()} == {0: False, 1: False, 2: True, 3: True}


def test_facts_are_dealt_once(spark):
    """Netting, windows and sums need no exchange of their own: lines, orders, their join and customers have one each,
    the few nations two."""
    plan = replay.join_deltas(CHAIN, as_logs(spark, random_changes(8, 3)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 6 and plan.count("BroadcastExchange") == 1, plan


def test_metrics(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    metrics.append_json(metrics.record(spark, job="a", parallelism=1, updates_total=100, join_deltas_total=10, wall_time_ms=50, phases_ms={"load": 5, "join": 10, "sink": 10}), path)
    metrics.append_json(metrics.record(spark, job="b", parallelism=4, updates_total=100, join_deltas_total=0, wall_time_ms=0, phases_ms={}), path)
    got = {r.job: r for r in metrics.summary(metrics.read_json(spark, path)).collect()}
    assert (got["a"].processing_time_ms, got["a"].updates_per_sec, got["a"].cluster_gap_ms) == (20, 5000.0, 30)
    assert got["b"].updates_per_sec == 0.0
    assert len({r.run_id for r in got.values()}) == 2


def test_snapshot_is_replaced_and_quoted(spark, tmp_path):
    top = spark.createDataFrame([(1, 'A "x", y', 12.5, 3.0)], "c_custkey long, c_name string, revenue double, c_acctbal double")
    for _ in range(2):
        sinks.write_snapshot(top, f"file://{tmp_path}", "BATCH_END", 7)
    lines = spark.read.text(f"file://{tmp_path}/trigger=batch_end/snapshot=7").collect()
    assert [r.value for r in lines] == ["c_custkey,c_name,revenue,c_acctbal", '1,"A ""x"", y",12.5000,3.00']


def test_only_differing_buckets_are_compared(spark, monkeypatch):
    from tidejoin.operators import compare

    a = spark.createDataFrame([(k, k % 7 if k % 5 else None) for k in range(200)] + [(3, 3)], "k long, v long")
    b = spark.createDataFrame([(k, (k + (k == 11)) % 7 if k % 5 else None) for k in range(200)] + [(500, None), (3, 3), (3, 3)], "k long, v long")
    stored = [compare.stored_by_key(df, ["k"], ["k", "v"], 16) for df in (a, b)]
    seen = []
    real = compare.two_way
    monkeypatch.setattr(compare, "two_way", lambda x, y, c: seen.append({r[0] for df in (x, y) for r in df.select("bucket").collect()}) or real(x, y, c))
    got = sorted(map(tuple, compare.by_digest(*stored, ["k", "v"]).collect()), key=repr)
    assert got == sorted([tuple(r) for r in real(a, b, ["k", "v"]).collect()], key=repr) and len(got) == 4
    buckets = {r[0] for df in stored for r in df.where("k in (3, 11, 500)").select("bucket").collect()}
    assert seen == [buckets] and len(buckets) <= 3
    assert compare.by_digest(stored[0], stored[0], ["k", "v"]).count() == 0 and seen[-1] == set()


def test_stream_totals_add_up(spark, tmp_path):
    from tidejoin.operators.metrics import StreamTotals

    totals = StreamTotals()
    spark.streams.addListener(totals)
    try:
        for i in range(2):
            spark.range(10 + i).write.mode("append").parquet(f"{tmp_path}/in")
            q = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            q.awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        for _ in range(100):
            if totals.rows >= 21:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(totals)
    assert totals.rows == 21 and totals.batches >= 2 and totals.took["addBatch"] > 0


def test_groups_from_weights_and_hot_keys_equal_the_plain_replay(spark):
    """Sums from keys alone, and the join whose keys are split, on random changelogs and on one with a hot order."""
    from tidejoin.streaming.queries import unfiltered

    PLAIN = unfiltered(CHAIN)  # noqa: N806
    for seed in (3, 9):
        lg = as_logs(spark, random_changes(seed, 4))
        plain = replay.join_deltas(PLAIN, lg)
        want = {tuple(r) for r in aggregate.signed_aggregate(PLAIN, plain).collect()}
        assert {tuple(r) for r in replay.signed_groups(PLAIN, lg).collect()} == want
        split = replay.join_deltas(PLAIN, lg, hot_rows=0)
        assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, plain.select(*split.columns).collect()), key=repr)
    hot = lg["lineitem"].withColumn("l_orderkey", F.lit(5).cast("long"))
    assert replay.hottest(hot, "l_orderkey") == hot.count() and replay.hottest(hot.limit(0), "l_orderkey") == 0
    plan = replay.join_deltas(PLAIN, {**lg, "lineitem": hot}, hot_rows=3)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan
