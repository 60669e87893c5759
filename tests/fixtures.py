"""The hand-made unit set: 5 nations, 10 customers, 20 orders, 50 lines, with the edges that matter."""

from datetime import date

from tidejoin.plans.chain import q10

L = "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice decimal(15,2), l_discount decimal(15,2), l_returnflag string"
O = "o_orderkey long, o_custkey long, o_orderdate date"  # noqa: E741
C = "c_custkey long, c_nationkey long, c_name string, c_acctbal decimal(15,2)"
N = "n_nationkey long, n_name string"
SCHEMAS = {"lineitem": L, "orders": O, "customer": C, "nation": N}


def tables():
    from decimal import Decimal as D

    nations = [(i, f"N{i}") for i in range(5)]
    customers = [(i, i % 5, f'C "{i}", Inc' if i == 3 else f"C{i}", D(i * 100) - D("250.5")) for i in range(10)]
    edge = {0: date(1996, 10, 1), 1: date(1996, 12, 31), 2: date(1997, 1, 1), 3: date(1996, 9, 30)}
    orders = [(i, i % 9, edge.get(i, date(1996, 11, 1 + i))) for i in range(20)]
    lines = [(i % 20, i // 20, i % 7, D(100 + i), D("0.05") if i % 2 else D("0.00"), "A" if i % 10 == 9 else "R") for i in range(48)]
    lines += [lines[4], lines[4]]  # identical rows
    return {"lineitem": lines, "orders": orders, "customer": customers, "nation": nations}


def frames(spark):
    return {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in tables().items()}


def logs(spark, changes):
    """Changelogs from {relation: [(row, op, batch)]}."""
    return {n: spark.createDataFrame([(*r, op, b) for r, op, b in changes.get(n, [])], f"{SCHEMAS[n]}, op int, batch long") for n in SCHEMAS}


CHAIN = q10()
