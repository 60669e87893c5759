"""What a task holds and what a batch reads, whatever the size of the input."""

from fixtures import CHAIN
from test_operators import as_logs, random_changes

from tidejoin.operators import aggregate, replay
from tidejoin.streaming.queries import unfiltered

PLAIN = unfiltered(CHAIN)


def bag(df):
    return sorted(map(str, df.collect()))


def test_replay_tasks_have_so_many_rows_and_sums_need_no_wide_columns(spark):
    logs = as_logs(spark, random_changes(11, 3))
    n = max(logs[r].count() for r in ("lineitem", "orders"))
    small = replay.joined_versions(PLAIN, logs, task_rows=10)
    assert "RepartitionByExpression [l_orderkey" in (plan := small._jdf.queryExecution().analyzed().toString())
    assert plan.count(f", {n // 10 + 1}") >= 2  # facts and the relation that they meet
    narrow = replay.join_deltas(PLAIN, replay.narrowed(PLAIN, logs, ["l_extendedprice", "l_discount"]))
    assert "c_name" not in narrow.columns and "n_name" not in narrow.columns
    sums = [aggregate.group_changes(PLAIN, d, by_batch=False) for d in (replay.join_deltas(PLAIN, logs), narrow)]
    # a group whose rows all went may come with a zero or not at all, by what cancels first
    assert bag(sums[0].where("cnt <> 0")) == bag(sums[1].where("cnt <> 0"))
