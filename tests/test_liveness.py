"""Liveness by counters against two whole states per batch."""

from fixtures import CHAIN
from pyspark.sql import functions as F
from test_operators import as_logs, random_changes

from tidejoin.operators import liveness
from tidejoin.operators.changelog import data_columns, filtered_logs, state_at
from tidejoin.streaming.queries import unfiltered

PLAIN = unfiltered(CHAIN)


def whole(logs, b):
    rels = {n: state_at(log, b).where("w > 0").drop("w") for n, log in logs.items()}
    return {n: {tuple(r) for r in df.collect()} for n, df in liveness.live(PLAIN, rels).items()}


def test_events_of_random_changelogs(spark, monkeypatch):
    monkeypatch.setattr(liveness, "PARTS", 2)
    logs = filtered_logs(CHAIN, as_logs(spark, random_changes(4, 4)))
    found = liveness.liveness_deltas(PLAIN, logs, 3)
    rows = [(n, tuple(r)) for n, df in found.items() for r in df.collect()]
    before = {n: set() for n in logs}
    total = 0
    for b in range(4):
        now = whole(logs, b)
        for n in logs:
            want = {(*r, 1) for r in now[n] - before[n]} | {(*r, -1) for r in before[n] - now[n]}
            got = [r[:-1] for m, r in rows if m == n and r[-1] == b]
            assert len(got) == len(set(got)) and set(got) == want
            total += len(want)
        before = now
    assert total > 20


def test_batches_one_by_one_give_the_same_events(spark):
    logs = filtered_logs(CHAIN, as_logs(spark, random_changes(5, 4)))
    kept, steps = liveness.Liveness(PLAIN, {n: log.drop("op", "batch") for n, log in logs.items()}), []
    for b in range(4):
        change = {n: log.where(f"batch = {b}").withColumn("w", F.col("op").cast("long")).drop("op", "batch") for n, log in logs.items()}
        steps += [(n, *r, b) for n, df in kept.apply(change).items() for r in df.collect()]
    found = liveness.liveness_deltas(PLAIN, logs, 3)
    assert len(steps) > 20 and sorted(map(str, steps)) == sorted(str((n, *r)) for n, df in found.items() for r in df.collect())


def test_a_changelog_takes_no_jobs_per_batch(spark):
    logs, jobs = filtered_logs(CHAIN, as_logs(spark, random_changes(6, 4))), []
    for last in (1, 3):
        spark.sparkContext.setJobGroup(f"liveness-{last}", "")
        liveness.liveness_deltas(PLAIN, logs, last)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"liveness-{last}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] > 4 and jobs[1] <= jobs[0] + 8


def test_a_key_lives_while_its_counter_is_above_zero(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, -1, 2), (1, -1, 4), (1, 1, 6), (None, 1, 0)], "k long, change int, batch long")
    assert sorted((r._key, r._from, r._to) for r in liveness.key_lives(rows, "k").collect()) == [(1, 0, 4), (1, 6, liveness.FOREVER)]


def weighted(df, w=1):
    return df.withColumn("w", F.lit(w).cast("long"))


def test_only_what_changes_is_read(spark):
    from fixtures import frames
    from tidejoin.operators.predicates import filtered

    rels = filtered(CHAIN, frames(spark))
    kept = liveness.Liveness(PLAIN, rels)
    first = kept.apply({n: weighted(df) for n, df in rels.items()})
    assert {n: df.count() for n, df in first.items()} == {n: len({tuple(r) for r in df.collect()}) for n, df in liveness.live(PLAIN, rels).items()}
    # one line goes: only lines are read, and nothing else changes
    line = rels["lineitem"].dropDuplicates(["l_orderkey", "l_linenumber"]).orderBy("l_orderkey", "l_linenumber").limit(1)
    n = rels["lineitem"].join(line, rels["lineitem"].columns, "left_semi").count()
    out = kept.apply({"lineitem": weighted(line, -n)})
    assert set(kept.reads) == {"lineitem"} and out["lineitem"].count() == 1
    # a second customer row under a key that lives: its counter stays above zero, no order is read
    twin = rels["customer"].orderBy("c_custkey").limit(1).withColumn("c_name", F.lit("twin"))
    out = kept.apply({"customer": weighted(twin)})
    assert set(out) == {"customer"} and set(kept.reads) == {"customer"}
    out = kept.apply({"customer": weighted(twin, -1)})
    assert set(out) == {"customer"} and "orders" not in kept.reads
    # a nation goes: its customers, their orders and lines are found
    gone = rels["nation"].where("n_nationkey = 1")
    out = kept.apply({"nation": weighted(gone, -1)})
    assert set(out) == set(rels) and {r.change for df in out.values() for r in df.collect()} == {-1}
    back = kept.apply({"nation": weighted(gone)})
    assert {n: df.count() for n, df in back.items()} == {n: df.count() for n, df in out.items()}


def test_rows_that_wait_and_nulls(spark):
    n = {r.name: spark.createDataFrame([], f"{s}") for r, s in zip(PLAIN.rels, ("l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice decimal(15,2), l_discount decimal(15,2)", "o_orderkey long, o_custkey long", "c_custkey long, c_nationkey long, c_name string, c_acctbal decimal(15,2)", "n_nationkey long, n_name string"), strict=True)}
    kept = liveness.Liveness(PLAIN, n)
    assert kept.apply({}) == {}
    row = lambda name, *v: spark.createDataFrame([v], n[name].schema)
    assert kept.apply({"orders": weighted(row("orders", 1, None)), "nation": weighted(n["nation"])}) == {}
    assert kept.apply({"orders": weighted(row("orders", 2, 5))}) == {}
    out = kept.apply({"customer": weighted(row("customer", 5, 3, "c", None)), "nation": weighted(row("nation", 3, None))})
    assert {k: [tuple(r) for r in v.collect()] for k, v in out.items()} == {"nation": [(3, None, 1)], "customer": [(5, 3, "c", None, 1)], "orders": [(2, 5, 1)]}
    assert data_columns(out["orders"]) == ["o_orderkey", "o_custkey", "change"]
