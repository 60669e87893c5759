"""The command-line jobs on the hand-made set as pipe-delimited files with an update set."""

import csv
import glob
from collections import Counter

import pytest
from fixtures import tables
from test_operators import brute

from tidejoin import jobs
from tidejoin.operators import metrics


def tbl(path, t):
    """Files of the four tables, unused columns filled."""
    n = "".join(f"{k}|{name}|0|c|\n" for k, name in t["nation"])
    c = "".join(f"{k}|{name}|addr {k}|{nk}|1-2|{bal}|SEG|note|\n" for k, nk, name, bal in t["customer"])
    (path / "nation.tbl").write_text(n)
    (path / "customer.tbl").write_text(c)
    (path / "orders.tbl").write_text("".join(map(order, t["orders"])))
    (path / "lineitem.tbl").write_text("".join(map(line, t["lineitem"])))


def order(o):
    return f"{o[0]}|{o[1]}|O|1.00|{o[2]}|1-URGENT|Clerk|0|x|\n"


def line(l):  # noqa: E741
    return f"{l[0]}|{l[2]}|1|{l[1]}|1.00|{l[3]}|{l[4]}|0.00|{l[5]}|O|1996-11-01|1996-11-01|1996-11-01|NONE|MAIL|x|\n"


@pytest.fixture(scope="module")
def case(tmp_path_factory):
    path, t = tmp_path_factory.mktemp("tbl"), tables()
    tbl(path, t)
    gone, come = t["orders"][5], (5, 7, t["orders"][5][2])
    (path / "orders.tbl.u1").write_text(order(gone) + order(come))
    dead, new = t["lineitem"][6], (*t["lineitem"][6][:3], t["lineitem"][6][3] + 50, *t["lineitem"][6][4:])
    (path / "lineitem.tbl.u1").write_text(line(dead) + "\n" + line(new))
    after = {**t, "orders": [come if o == gone else o for o in t["orders"]], "lineitem": [new if x == dead else x for x in t["lineitem"]]}
    return f"file://{path}", brute(t), brute(after)


def top(path):
    with open(glob.glob(f"{path}/top/part-*.csv")[0]) as f:
        return [(int(r["c_custkey"]), r["revenue"]) for r in csv.DictReader(f)]


def ranked(groups):
    return [(k, f"{v[0]:.4f}") for k, v in sorted(groups.items(), key=lambda x: (-x[1][0], x[0]))]


@pytest.mark.parametrize(("job", "policy"), [("bulk", "job_end"), ("replay", "batch_end"), ("stream", "on_change")])
def test_top_rows(spark, case, tmp_path, job, policy):
    source, before, after = case
    jobs.main(spark, [job, "--input", source, "--output", f"file://{tmp_path}", "--start", "1996-10-01", "--policy", policy, "--metrics", f"file://{tmp_path}/runs"])
    assert top(tmp_path) == ranked(before if job == "bulk" else after)
    run = metrics.read_json(spark, f"file://{tmp_path}/runs").first()
    assert run.job == job and run.updates_total == 5 + 10 + 20 + 50 + 4
    assert run.groups_total == len(before if job == "bulk" else after) and run.snapshots_total >= 1
    assert {"join", "topk", "sink"} <= set(run.phases_ms) and sum(run.phases_ms.values()) <= run.wall_time_ms + 50
    if job == "replay":
        shots = Counter(r.batch for r in spark.read.option("header", True).csv(f"file://{tmp_path}/snapshots").collect())
        assert shots == {3: len(before), 4: len(after)}


@pytest.mark.parametrize("job", ["replay", "stream"])
def test_each_change_is_a_batch(spark, case, tmp_path, job):
    source, _, after = case
    jobs.main(spark, [job, "--input", source, "--output", f"file://{tmp_path}", "--start", "1996-10-01", "--policy", "batch_end", "--batch-size", "1"])
    assert top(tmp_path) == ranked(after)
    if job == "replay":
        shots = {r.batch for r in spark.read.option("header", True).csv(f"file://{tmp_path}/snapshots").collect()}
        assert shots == set(range(3, 8))


def test_verify_and_refresh_layout(spark, case, tmp_path):
    jobs.main(spark, ["verify", "--input", case[0], "--output", f"file://{tmp_path}", "--start", "1996-10-01"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/differences").count() == 0


def test_a_running_stream_takes_sets_that_come_later(spark, case, tmp_path):
    """The second set is written while the job runs."""
    import shutil
    import threading

    source, _, after = case
    mine = tmp_path / "in"
    shutil.copytree(source.removeprefix("file://"), mine)
    late = {p: (mine / p).read_text() for p in ("orders.tbl.u1", "lineitem.tbl.u1")}
    (mine / "orders.tbl.u1").unlink()
    store = tmp_path / "out/store/commits"

    def later():
        while not (store / "v=0").exists():  # the first set has been applied
            threading.Event().wait(0.2)
        (mine / ".draft").write_text(late["orders.tbl.u1"])
        (mine / ".draft").rename(mine / "orders.tbl.u2")

    t = threading.Thread(target=later, daemon=True)
    t.start()
    jobs.main(spark, ["stream", "--input", f"file://{mine}", "--output", f"file://{tmp_path}/out", "--start", "1996-10-01", "--every", "1 second", "--seconds", "45", "--policy", "on_change"])
    t.join(1)
    assert not t.is_alive() and (store / "v=1").exists()
    assert top(tmp_path / "out") == ranked(after)
    with pytest.raises(SystemExit):
        jobs.main(spark, ["replay", "--input", source, "--output", "x", "--every", "1 second"])
