"""Pipe-delimited tables, money texts and update sets."""

import pytest
from pyspark.sql import functions as F

from tidejoin.functions import money, revenue
from tidejoin.sources import tables, updates


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_tbl(spark, tmp_path):
    write(tmp_path / "nation.tbl", '7|NA"ME|1|a, "b"|\n\n8|X|2||\n')
    rows = tables.tbl_table(spark, f"file://{tmp_path}", "nation").collect()
    assert [(r.n_nationkey, r.n_name, r.n_comment or "") for r in rows] == [(7, 'NA"ME', 'a, "b"'), (8, "X", "")]
    assert tables.tbl_table(spark, f"file://{tmp_path}", "orders").count() == 0


def test_a_bad_number_fails(spark, tmp_path):
    write(tmp_path / "nation.tbl", "seven|A|1|c|\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        tables.tbl_table(spark, f"file://{tmp_path}", "nation").collect()


def test_money(spark):
    texts = ["1.5", "1.239", "-1.239", "12", "-0.5", "0.999", "7.05"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(money.cents(F.col("t"))).collect()]
    assert got == [150, 123, -123, 1200, -50, 99, 705]
    row = spark.range(1).select(money.discount_units(F.lit("0.06")), money.currency(F.lit(-12345)), money.ratio(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (600, "-123.45", 0.0)


def test_revenue_modes(spark):
    row = spark.createDataFrame([("100.01", "0.07")], "p string, d string").select(revenue.exact(F.col("p"), F.col("d")).alias("e"), revenue.truncated_cents(F.col("p"), F.col("d")).alias("c")).first()
    assert str(row.e) == "93.0093" and row.c == 10001 - 10001 * 700 // 10000


ORDER = "{k}|{c}|O|1.00|1996-11-01|1-URGENT|Clerk|0|note|\n"


def test_pairs_alternate_and_stop_at_a_gap(spark, tmp_path):
    line = lambda k, c: ORDER.format(k=k, c=c)
    write(tmp_path / "orders.tbl.u1", line(1, 1) + "\n" + line(1, 2) + line(2, 1) + line(2, 2))
    write(tmp_path / "orders.tbl.u3", line(9, 9) * 2)
    got = updates.update_sets(spark, f"file://{tmp_path}")["orders"].collect()
    assert sorted((r.o_orderkey, r.o_custkey, r.op, r.batch) for r in got) == [(1, 1, -1, 4), (1, 2, 1, 4), (2, 1, -1, 4), (2, 2, 1, 4)]


def test_lines_of_a_split_file_are_numbered(spark, tmp_path):
    text = "".join(ORDER.format(k=k, c=c).replace("\n", "\r\n" if k % 3 else "\n\n") for k in range(50) for c in (1, 2))
    path = write(tmp_path / "orders.tbl.u1", text)
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        lines = updates.numbered_lines(spark, [(path, 4)]).collect()
        got = updates.pair_lines(spark, [(path, 4)], "orders").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert len({r.block for r in lines}) > 5
    assert [r.line for r in sorted(lines, key=lambda r: r.n)] == text.split() and sorted(r.n for r in lines) == list(range(1, 101))
    assert sorted((r.o_orderkey, r.o_custkey, r.op, r.batch) for r in got) == [(k, c, op, 4) for k in range(50) for c, op in ((1, -1), (2, 1))]


def test_refresh_layout_looks_rows_up(spark, tmp_path):
    write(tmp_path / "orders.tbl.u1", ORDER.format(k=5, c=1))
    write(tmp_path / "delete.1", "1|\n")
    write(tmp_path / "delete.2", "5|\n")
    write(tmp_path / "orders.tbl", ORDER.format(k=1, c=7) + ORDER.format(k=2, c=8))
    base = {"orders": tables.tbl_table(spark, f"file://{tmp_path}", "orders")}
    got = updates.update_sets(spark, f"file://{tmp_path}", ("orders",), layout="refresh", tables=base)["orders"].collect()
    assert sorted((r.o_orderkey, r.o_custkey, r.op, r.batch) for r in got) == [(1, 7, -1, 4), (5, 1, -1, 5), (5, 1, 1, 4)]


def test_bulk_batches(spark):
    t = {n: spark.range(2) for n in updates.LOAD_ORDER}
    assert [updates.bulk(t)[n].first().batch for n in updates.LOAD_ORDER] == [0, 1, 2, 3]


def test_one_scan_for_any_number_of_update_files(spark, tmp_path):
    for n in range(1, 8):
        write(tmp_path / f"orders.tbl.u{n}", ORDER.format(k=n, c=1) + ORDER.format(k=n, c=2))
    log = updates.update_sets(spark, f"file://{tmp_path}")["orders"]
    assert log._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2  # lines, and the sizes of their splits
    assert sorted((r.o_orderkey, r.op, r.batch) for r in log.collect()) == sorted((n, op, n + 3) for n in range(1, 8) for op in (-1, 1))


def test_pairs_of_an_empty_table(spark, tmp_path):
    from tidejoin import queries

    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert queries.changelog_pairs(spark, str(tmp_path)).count() == 0


def test_bucketed_facts_join_without_an_exchange(spark):
    from fixtures import CHAIN, frames
    from tidejoin.operators.fk_join import fk_join
    from tidejoin.operators.predicates import filtered
    from tidejoin.sources.bucketed import bucketed

    plain = filtered(CHAIN, frames(spark))
    stored = plain | {n: bucketed(plain[n], k, 4) for n, k in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))}
    assert len(stored["lineitem"].inputFiles()) <= 4
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda r: r["lineitem"].join(r["orders"], F.col("l_orderkey") == F.col("o_orderkey"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(stored) and "Exchange hashpartitioning(l_orderkey" in plan(plain)
        rows = lambda r: sorted(map(tuple, fk_join(CHAIN, r).collect()), key=repr)
        assert rows(stored) == rows(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
