"""A chain of relations joined by foreign keys, its filters, its measure and its grouping.

The first relation is the fact table; each refers to the next by one foreign key.
Everything else in the library takes such a chain, so TPC-H Q10 is one instance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Callable[[], Column]


@dataclass(frozen=True)
class Rel:
    """A relation: the columns that the chain needs, its key, its foreign key, its filter."""

    name: str
    columns: tuple[str, ...]
    key: tuple[str, ...]
    fk: str | None = None
    where: Predicate | None = field(default=None, compare=False)

    def rows(self, df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        """The needed columns (and ``extra`` ones, as op and batch) of the rows that pass the filter."""
        if self.where is not None:
            df = df.where(self.where())
        return df.select(*self.columns, *extra)


@dataclass(frozen=True)
class FkChain:
    """``rels`` from the fact table to the last dimension; ``measure`` over fact columns; ``group_key``, a key on the way."""

    rels: tuple[Rel, ...]
    measure: Callable[[], Column]
    group_key: str
    attributes: tuple[str, ...] = ()

    @property
    def fact(self) -> Rel:
        return self.rels[0]

    def rel(self, name: str) -> Rel:
        return next(r for r in self.rels if r.name == name)

    def pairs(self) -> list[tuple[Rel, Rel]]:
        """(referring, referenced) relations, from the fact table on."""
        return list(zip(self.rels[:-1], self.rels[1:], strict=True))


#: First day and length in months of the order window of the registered queries.
WINDOW_START, WINDOW_MONTHS = "1996-10-01", 3


def q10(start: str = WINDOW_START, months: int = WINDOW_MONTHS, attributes: tuple[str, ...] = ("c_name", "c_acctbal", "n_name"), revenue_mode: str = "exact") -> FkChain:
    """TPC-H Q10, returned items: lineitem -> orders -> customer -> nation, revenue by customer."""
    from ..functions.revenue import MODES
    from ..operators.predicates import order_window, returned

    customer = tuple(a for a in attributes if a.startswith("c_"))
    return FkChain(
        (
            Rel("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount"), ("l_orderkey", "l_linenumber"), "l_orderkey", returned),
            Rel("orders", ("o_orderkey", "o_custkey"), ("o_orderkey",), "o_custkey", lambda: order_window(start, months)),
            Rel("customer", ("c_custkey", "c_nationkey", *customer), ("c_custkey",), "c_nationkey"),
            Rel("nation", ("n_nationkey", "n_name"), ("n_nationkey",)),
        ),
        lambda: MODES[revenue_mode](F.col("l_extendedprice"), F.col("l_discount")),
        "c_custkey",
        attributes,
    )
