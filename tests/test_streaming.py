"""The maintained view: restart, replay, policies, compaction."""

import pytest
from fixtures import CHAIN, frames, tables
from pyspark.sql import functions as F
from test_operators import as_logs, brute, random_changes, view

from tidejoin.operators import metrics
from tidejoin.operators.changelog import mixed
from tidejoin.streaming.maintainer import Maintainer, Policy, run, start
from tidejoin.streaming.queries import maintained, unfiltered, write_files
from tidejoin.streaming.store import Store

PLAIN = unfiltered(CHAIN)


@pytest.fixture(scope="module")
def stream(spark):
    lg = as_logs(spark, random_changes(8, 3))
    return mixed(lg)


def empty(stream):
    return {r.name: stream.select(f"{r.name}.*").limit(0) for r in PLAIN.rels}


def test_restart_replay_policies_and_compaction(spark, stream, tmp_path):
    base = f"file://{tmp_path}"
    parts = [stream.where(f"batch = {b}").cache() for b in range(3)]
    store = Store(spark, f"{base}/store", PLAIN, buckets=2)
    store.seed(empty(stream))
    seen = []
    keeper = Maintainer(store, Policy.ON_CHANGE, lambda rows, batch, trigger: seen.append((batch, trigger, rows.count())))
    schema = stream.withColumn("part", F.lit(0)).schema
    write_files(parts[:1], f"{base}/source")
    run(spark, f"{base}/source", schema, keeper, f"{base}/checkpoint")
    first = view(store.view())
    # the same batch again, as after a crash between the commit and the checkpoint
    keeper.process(parts[0], 0)
    assert view(store.view()) == first
    for i in (1, 2):
        parts[i].coalesce(1).write.mode("append").parquet(f"{base}/source/part={i}")
    again = start(spark, f"{base}/source", schema, Maintainer(Store(spark, f"{base}/store", PLAIN, 2)), f"{base}/checkpoint")
    assert again.awaitTermination(300)
    run_record = metrics.summary(metrics.of_stream(spark, again.recentProgress, "stream")).first()
    assert run_record.updates_total == parts[1].count() + parts[2].count() and 0 < run_record.processing_time_ms <= run_record.wall_time_ms
    top = run(spark, f"{base}/source", schema, Maintainer(Store(spark, f"{base}/store", PLAIN, 2), Policy.JOB_END), f"{base}/checkpoint")
    changes = random_changes(8, 3)
    want = brute({n: [r for r in dict.fromkeys(x[0] for x in c) for _ in range(sum(op for y, op, _ in c if y == r))] for n, c in changes.items()})
    assert {k: v for k, v in view(store.view()).items() if v[1]} == want
    assert {r.c_custkey for r in top.collect()} == {k for k, v in want.items() if v[0] > 0}
    assert seen[0][1] == "on_change" and seen[-1][1] == "job_end"
    small = store.compacted(f"{base}/small")
    assert {k: v for k, v in view(small.view()).items() if v[1]} == want
    assert small.last() == store.last()


def test_seeded_store_equals_bulk_view(spark, tmp_path):
    from tidejoin.operators.predicates import filtered

    store = Store(spark, f"file://{tmp_path}/store", PLAIN, buckets=2)
    store.seed(filtered(CHAIN, frames(spark)))
    assert view(store.view()) == brute(tables())
    assert {r.c_custkey for r in Maintainer(store).top(-1).collect()} == set(brute(tables()))


def test_a_part_of_several_files_is_one_micro_batch(spark, stream):
    parts = [stream.where(f"batch = {b}").repartition(3) for b in range(3)]
    seen = []
    keeper, _ = maintained(spark, parts, Policy.BATCH_END, lambda rows, batch, trigger: seen.append((batch, trigger)))
    source = keeper.store.path.removesuffix("store") + "source"
    assert all(len(spark.read.parquet(f"{source}/part={i}").inputFiles()) == 3 for i in range(3))
    assert seen == [(0, "batch_end"), (1, "batch_end"), (2, "batch_end"), (2, "job_end")]


def test_a_stream_goes_on_until_it_is_stopped(spark, stream, tmp_path):
    base = f"file://{tmp_path}"
    parts = [stream.where(f"batch = {b}") for b in range(3)]
    store = Store(spark, f"{base}/store", PLAIN, buckets=2)
    store.seed(empty(stream))
    write_files(parts[:1], f"{base}/source")
    schema = stream.withColumn("part", F.lit(0)).schema
    query = start(spark, f"{base}/source", schema, Maintainer(store), f"{base}/checkpoint", every="1 second")
    try:
        for i in (1, 2):
            query.processAllAvailable()
            assert query.isActive
            write_files([parts[i]], f"{base}/source", i)
        query.processAllAvailable()
    finally:
        query.stop()
    assert not query.isActive
    other = Store(spark, f"{base}/other", PLAIN, buckets=2)
    other.seed(empty(stream))
    Maintainer(other).process(stream, 0)
    kept = {k: v for k, v in view(store.view()).items() if v[1]}
    assert kept == {k: v for k, v in view(other.view()).items() if v[1]}


def test_a_reopened_store_knows_relations_without_rows(spark, stream, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", PLAIN, buckets=4)
    store.seed(empty(stream))
    again = Store(spark, store.path, PLAIN, buckets=4)
    for r in PLAIN.rels:
        assert again.state(r.name, 5).count() == 0 and again.state(r.name, 5).columns == [*r.columns, "w"]
    assert again.state(PLAIN.fact.name, 5, []).count() == 0


def test_touched_buckets_hold_all_keys_of_a_batch(spark, stream):
    store = Store(spark, "unused", PLAIN, buckets=4)
    touched = store.touched(stream)
    assert set(touched) == {r.relation for r in stream.select("relation").distinct().collect()}
    for r, key in zip(PLAIN.rels[:2], (PLAIN.fact.fk, PLAIN.rels[1].key[0]), strict=True):
        keys = stream.where(F.col("relation") == r.name).select(store._bucket(f"{r.name}.{key}").alias("b"))
        assert touched[r.name] == {row.b for row in keys.collect()}
    alone = stream.where(F.col("relation") == PLAIN.fact.name).select("relation", "op", "batch", PLAIN.fact.name)
    assert set(store.touched(alone)) == {PLAIN.fact.name}
    assert store.touched(stream.limit(0)) == {}


def test_bases_bound_what_is_read_and_a_second_seed_changes_nothing(spark, stream, tmp_path):
    """A base after every second batch: the same view, few folders, and a restart that seeds again."""
    plain = Store(spark, f"file://{tmp_path}/plain", PLAIN, buckets=2)
    based = Store(spark, f"file://{tmp_path}/based", PLAIN, buckets=2, base_every=2)
    for store in (plain, based):
        store.seed(empty(stream))
        keeper = Maintainer(store)
        for b in range(3):
            keeper.process(stream.where(F.col("batch") == b), b)
        for b in range(3, 6):  # batches without effect
            keeper.process(stream.limit(0), b)
    live = lambda v: {k: x for k, x in v.items() if x[1]}
    assert live(view(based.view())) == live(view(plain.view())) and based.last() == plain.last() == 5
    assert based.names("bases") == [5] and not based.names("view") and not based.names("state/lineitem")
    for r in PLAIN.rels:
        sums = lambda s, r=r: {tuple(x) for x in s.state(r.name, 6).groupBy(*r.columns).agg(F.sum("w").alias("w")).where("w <> 0").collect()}
        assert sums(based) == sums(plain)
    again = Store(spark, based.path, PLAIN, buckets=2, base_every=2)
    again.seed(empty(stream))  # as a job that starts again does
    assert live(view(again.view())) == live(view(plain.view())) and again.committed() == based.committed()
    Maintainer(again).process(stream.where("batch = 1"), 6)
    # a base without its mark doesn't count
    (tmp_path / "based/bases/v=5/whole").unlink()
    assert again.names("bases") == [5] and again.state("nation", 7).count() <= plain.state("nation", 7).count()


def test_a_batch_that_touches_no_kept_group_reads_no_view(spark, monkeypatch):
    from tidejoin.operators.topk import Reserve, top_k

    groups = spark.createDataFrame([(k, 1000 - 10 * k, 1) for k in range(60)], "c_custkey long, revenue long, cnt long")
    kept = Reserve("c_custkey", k=5, spare=10)
    kept.fill(groups, 0)
    assert kept.ranking() == [(k, 1000 - 10 * k) for k in range(5)] and kept.ceiling == 1000 - 150
    change = lambda *rows: spark.createDataFrame(rows, groups.schema)
    kept.apply(change((40, 30, 1), (50, -500, -1)), 1)
    assert kept.ceiling == 880 and kept.ranking() == [(k, 1000 - 10 * k) for k in range(5)]
    kept.apply(change((2, 15, 1), (0, -1000, -1), (77, 1, 1)), 2)
    assert kept.ranking() == [(2, 995), (1, 990), (3, 970), (4, 960), (5, 950)]
    kept.apply(change((45, 100, 1)), 3)
    assert kept.ranking() is None  # a group outside may be among the best now
    few = Reserve("c_custkey", k=5, spare=10)
    few.fill(groups.limit(3), 0)
    assert [k for k, _ in few.ranking()] == [0, 1, 2]
    few.apply(change((9, 5, 1)), 1)
    assert few.ranking() is None
    tied = spark.createDataFrame([(k, 7, 1) for k in range(40)], groups.schema)
    ties = Reserve("c_custkey", k=3, spare=2)
    ties.fill(tied, 0)
    assert sorted(ties.kept) == [r[0] for r in top_k(tied, "c_custkey", 5).collect()]


def test_the_ranking_of_a_stream_comes_from_the_reserve(spark, stream, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store", PLAIN, buckets=2)
    store.seed(empty(stream))
    reads = []
    real = Store.view
    monkeypatch.setattr(Store, "view", lambda self, upto=None: reads.append(upto) or real(self, upto))
    seen = []
    keeper = Maintainer(store, Policy.BATCH_END, lambda rows, batch, trigger: seen.append([(r.c_custkey, r.revenue) for r in rows.collect()]))
    for b in range(3):
        keeper.process(stream.where(F.col("batch") == b), b)
    n = len(reads)
    assert reads[0] == 0
    # a batch without effect reads no view
    keeper.process(stream.limit(0), 3)
    assert len(reads) == n and len(seen) == 4
    for b, rows in enumerate(seen):
        want = sorted(((r.c_custkey, r.revenue) for r in real(store, min(b, 2)).where("cnt > 0 and revenue > 0").collect()), key=lambda x: (-x[1], x[0]))[:20]
        assert rows == want


def test_update_mode_writes_changed_groups_alone(spark, tmp_path):
    from tidejoin.streaming.keyed_sink import KeyedSink

    sink = KeyedSink(spark, f"file://{tmp_path}/sums", ["k"], base_every=2)
    source = f"file://{tmp_path}/in"
    for v, rows in enumerate([[(k, k) for k in range(50)], [(3, 10), (4, -4)], [(4, 4), (99, 1)]]):
        spark.createDataFrame(rows, "k long, x long").write.mode("append").parquet(source)
        sums = spark.readStream.schema("k long, x long").parquet(source).groupBy("k").agg(F.sum("x").alias("s"))
        sizes = []
        one = lambda df, n, sizes=sizes: (sizes.append((n, df.count())), sink(df, n))
        sums.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        assert sizes == [(v, len(rows))]
    want = {k: k for k in range(50)} | {3: 13, 99: 1}
    assert {r.k: r.s for r in sink.rows().collect()} == want and sink.base() == 1
    # the last batch again, as after a crash
    sink(spark.createDataFrame([(4, 4), (99, 1)], "k long, s long"), 2)
    assert {r.k: r.s for r in sink.rows().collect()} == want
