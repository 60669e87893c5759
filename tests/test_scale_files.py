"""Update files are numbered without a shuffle of their lines."""

from pyspark.sql import functions as F

from tidejoin.operators.changelog import filtered_logs
from tidejoin.plans.chain import q10
from tidejoin.sources import updates
from tidejoin.sources.updates import pair_lines
from tidejoin.streaming import store as stores
from tidejoin.streaming.queries import unfiltered


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    for name in ("orders.tbl.u1", "orders.tbl.u2"):
        (tmp_path / name).write_text("".join(f"{k}|{k}|{s}|1.00|1996-11-01|x|x|0|x|\r\n\n" for k in range(300) for s in "OF"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        log = pair_lines(spark, [(f"{tmp_path}/orders.tbl.u{n}", n) for n in (1, 2)], "orders")
        got = sorted((r.o_orderkey, r.op, r.o_orderstatus, r.batch) for r in log.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((k, op, s, n) for k in range(300) for op, s in ((-1, "O"), (1, "F")) for n in (1, 2))
    assert log._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1  # over a row per split


def order(key, day, status="O"):
    return f"{key}|{key}|{status}|1.00|{day}|x|x|0|x|\n"


def item(key, flag):
    return f"{key}|1|1|1|1.00|5.00|0.10|0.00|{flag}|x|1996-11-01|1996-11-01|1996-11-01|x|x|x|\n"


def sets(path):
    """Half of the pairs fail their filter; a pair may have one line that does."""
    path.mkdir(parents=True)
    days = ("1996-11-01", "1995-01-01")
    for n in (1, 2):
        (path / f"orders.tbl.u{n}").write_text("".join(order(k, days[k % 2]) + "\n" + order(k, days[(k + n) % 2]) for k in range(200)))
        (path / f"lineitem.tbl.u{n}").write_text("".join(item(k, "RN"[k % 2]) + item(k, "RA"[(k + n) % 2]) for k in range(200)))
    return [str(path / f"{r}.tbl.u{n}") for r in ("orders", "lineitem") for n in (1, 2)]


def test_lines_that_a_filter_drops_are_counted_but_not_written(spark, tmp_path, monkeypatch):
    chain, texts = q10("1996-10-01", 3), []
    monkeypatch.setattr(updates, "written", lambda df, name, real=updates.written: texts.append(real(df, name)) or texts[-1])
    wanted = {r.name: r.where for r in chain.rels}
    # in the second folder the path names both relations, so that nothing is judged by it
    for i, path in enumerate((tmp_path / "sets", tmp_path / "orders.tbl.uploads/sets")):
        lines = updates.located(spark.read.text(sets(path), lineSep="\n"))
        got = filtered_logs(chain, updates.changelogs_of(lines, wanted))
        want = filtered_logs(chain, updates.changelogs_of(lines))
        assert {n: sorted(map(str, d.collect())) for n, d in got.items()} == {n: sorted(map(str, d.collect())) for n, d in want.items()}
        ops = {n: {(r.batch, r.op): r["count"] for r in d.groupBy("batch", "op").count().collect()} for n, d in got.items()}
        assert ops == {n: {(b, op): 100 for b in (1, 2) for op in (-1, 1)} for n in ("orders", "lineitem")}
        kept, whole = texts[2 * i :]
        assert kept.count() == whole.count() == 1600
        assert kept.where("line is not null and file like '%/lineitem.tbl.u%'").count() == (400 if i == 0 else 800)
        assert kept.where("line is not null").count() == (800 if i == 0 else 1200)


def test_a_line_that_cannot_be_judged_is_kept(spark):
    wanted = {r.name: r.where for r in q10("1996-10-01", 3).rels}
    cases = [("orders", order(1, "1996-11-01"), True), ("orders", order(1, "1995-11-01"), False), ("orders", order(1, "no day"), True), ("orders", "1|1|O", True), ("orders", "1|1|O|1.00|1995-01-01", True)]
    cases += [("lineitem", item(1, "R"), True), ("lineitem", item(1, "N"), False), ("lineitem", "1|1|N", True), ("customer", "1|x|N|", True)]
    rows = spark.createDataFrame([(f"file:/d/{n}.tbl.u1/part-{i}", 0, line.strip()) for i, (n, line, _) in enumerate(cases)], "file string, block long, line string").coalesce(1)
    assert [r.keep for r in updates.unfailed(rows, wanted).collect()] == [k for _, _, k in cases]


def test_a_seed_reads_its_tables_once(spark, tmp_path, monkeypatch):
    from tidejoin.queries import rels

    seen = {}
    monkeypatch.setattr(stores, "partial_view", lambda chain, given, real=stores.partial_view: seen.update(given) or real(chain, given))
    loaded = rels(spark, "/root/testdata/sf0.001")
    store = stores.Store(spark, f"file://{tmp_path}/store", unfiltered(q10()), buckets=4)
    store.seed(loaded)
    for name, df in seen.items():
        assert df.columns == loaded[name].columns and all("/store/state/" in f for f in df.inputFiles())
    want = stores.partial_view(store.chain, loaded)
    assert sorted(map(str, store.view().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert seen["lineitem"].agg(F.count("*")).first() == loaded["lineitem"].agg(F.count("*")).first()
