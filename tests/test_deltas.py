"""A batch's delta join: how often it reads a state, and what it keeps in memory."""

from fixtures import CHAIN
from pyspark.sql import functions as F
from test_operators import as_logs, random_changes

from tidejoin.operators import changelog, delta
from tidejoin.operators.changelog import mixed
from tidejoin.streaming import maintainer
from tidejoin.streaming.queries import unfiltered
from tidejoin.streaming.store import Store

PLAIN = unfiltered(CHAIN)


def test_a_state_of_facts_meets_all_other_changes_in_one_join(spark):
    logs = as_logs(spark, random_changes(3, 3))
    old = {n: changelog.state_at(x, 1) for n, x in logs.items()}
    change = {n: delta.weighted(x.where("batch = 2")) for n, x in logs.items()}
    terms = delta.delta_terms(PLAIN, old, change)
    assert all(df.count() for df in change.values()) and len(terms) == 2
    # the net changes of the chain after the facts are a written table
    plan = terms[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "parquet" in plan
    got = delta.delta_join(PLAIN, old, change)
    now = {n: changelog.state_at(x, 2) for n, x in logs.items()}
    a, b = (delta.product_join(PLAIN, side) for side in (old, now))
    columns = [c for c in a.columns if c != "w"]
    want = b.unionByName(a.withColumn("w", -F.col("w"))).groupBy(*columns).agg(F.sum("w").alias("op")).where("op <> 0")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) != []


def test_changes_are_read_back_from_the_store(spark, tmp_path, monkeypatch):
    stream, seen = mixed(as_logs(spark, random_changes(8, 1))), []

    def join(chain, old, change):
        seen.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in change.values())
        return delta.delta_join(chain, old, change)

    monkeypatch.setattr(maintainer, "delta_join", join)
    store = Store(spark, f"file://{tmp_path}/store", PLAIN, buckets=2)
    store.seed({r.name: stream.select(f"{r.name}.*").limit(0) for r in PLAIN.rels})
    maintainer.Maintainer(store).process(stream, 0)
    assert len(seen) == 4 and not any("InMemoryRelation" in plan for plan in seen)
    assert store.view().count() > 0
