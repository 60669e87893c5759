"""Filters of the chain, applied alike to rows, to inserts and to deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.chain import FkChain


def order_window(start: str, months: int = 3, column: str = "o_orderdate") -> Column:
    """start <= column < start + months; both ends are constants, so the filter reaches the scan."""
    first = F.lit(start).cast("date")
    return (F.col(column) >= first) & (F.col(column) < F.add_months(first, months))


def returned(column: str = "l_returnflag") -> Column:
    return F.col(column) == "R"


def filtered(chain: FkChain, tables: dict[str, DataFrame], extra: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The chain's columns (and ``extra``) of the rows of each relation that pass its filter."""
    return {r.name: r.rows(tables[r.name], extra) for r in chain.rels}
