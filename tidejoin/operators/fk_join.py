"""The chain as one join, and the grouped view with dimension columns joined late."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.chain import FkChain

#: A dimension of at most so many rows is broadcast; beyond it the join shuffles, as Spark chooses.
BROADCAST_ROWS = 10_000


def on_keys(left: str, right: str) -> Column:
    return F.col(left) == F.col(right)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table may be broadcast; counting stops at the limit."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """A broadcast hint for a table whose size is checked, or that of a table that has no fewer rows and is cheaper to count."""
    return F.broadcast(df) if is_small(df if bound is None else bound) else df


def fk_join(chain: FkChain, rels: dict[str, DataFrame]) -> DataFrame:
    """Inner joins from the fact table to the last dimension, which is broadcast if it is small: its few keys would
    make a few huge partitions."""
    last = chain.rels[-1].name
    side = {**rels, last: small(rels[last])}
    return reduce(lambda df, p: df.join(side[p[1].name], on_keys(p[0].fk, p[1].key[0])), chain.pairs(), rels[chain.fact.name])


def partial_revenue(chain: FkChain, rels: dict[str, DataFrame]) -> DataFrame:
    """``group key, revenue, cnt`` from the join up to the relation that refers to the grouping relation.

    The sum is formed by the foreign key, before any wide dimension column is read.
    """
    names = [r.name for r in chain.rels]
    group = next(i for i, r in enumerate(chain.rels) if r.key == (chain.group_key,))
    df = reduce(lambda d, p: d.join(rels[p[1].name], on_keys(p[0].fk, p[1].key[0])), chain.pairs()[: group - 1], rels[names[0]])
    by = chain.rels[group - 1].fk
    return df.groupBy(F.col(by).alias(chain.group_key)).agg(F.sum(chain.measure()).alias("revenue"), F.count("*").alias("cnt"))


def with_attributes(chain: FkChain, groups: DataFrame, rels: dict[str, DataFrame]) -> DataFrame:
    """Groups that reach the end of the chain, with the grouping relation's and later columns."""
    group = next(i for i, r in enumerate(chain.rels) if r.key == (chain.group_key,))
    df = groups.join(rels[chain.rels[group].name], chain.group_key)
    last = chain.rels[-1].name
    for a, b in chain.pairs()[group:]:
        df = df.join(small(rels[b.name]) if b.name == last else rels[b.name], on_keys(a.fk, b.key[0]))
    return df


def revenue_view(chain: FkChain, rels: dict[str, DataFrame]) -> DataFrame:
    """``group key, revenue, cnt`` and the chain's attributes."""
    df = with_attributes(chain, partial_revenue(chain, rels), rels)
    return df.select(chain.group_key, "revenue", "cnt", *chain.attributes)
