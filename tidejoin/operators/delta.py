"""Signed join deltas of one batch of changes, by the delta rule."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.chain import FkChain
from ..sources.shared import written
from .changelog import OP, data_columns
from .fk_join import is_small, on_keys

WEIGHT = "w"


def product_join(chain: FkChain, sides: dict[str, DataFrame], start: int = 0, few: bool | None = None) -> DataFrame:
    """The chain's join of weighted rows (``w``); weights multiply.

    Joins begin at relation ``start`` and go to the fact table first, so that a small side there keeps every
    intermediate result small.  ``few``: whether the last dimension may be broadcast, if it
    has been counted already.
    """

    last = chain.rels[-1].name
    few = is_small(sides[last]) if few is None else few

    def meet(left: DataFrame, name: str, on: Column) -> DataFrame:
        right = F.broadcast(sides[name]) if few and name == last else sides[name]
        return left.join(right.withColumnRenamed(WEIGHT, "_w"), on).withColumn(WEIGHT, F.col(WEIGHT) * F.col("_w")).drop("_w")

    pairs, out = chain.pairs(), sides[chain.rels[start].name]
    for a, b in reversed(pairs[:start]):
        out = meet(out, a.name, on_keys(a.fk, b.key[0]))
    for a, b in pairs[start:]:
        out = meet(out, b.name, on_keys(a.fk, b.key[0]))
    return out


def delta_terms(chain: FkChain, old: dict[str, DataFrame], change: dict[str, DataFrame]) -> list[DataFrame]:
    """At most two terms: the fact table's own changes, joined with the new state of the others, and its old state, joined
    once with the net changes of the chain after it; those come the same way, from the last dimension on.  Retractions so use
    the old dimension rows; a relation that isn't in ``change`` has no term.

    The net changes of each part of the chain are written, so that Spark knows how few they are before it plans the join
    with a whole state: that isn't shuffled to meet a few rows.
    """
    new = {n: old[n].unionByName(change[n]) if n in change else old[n] for n in old}
    few = is_small(new[chain.rels[-1].name])  # it holds the old rows and the changes, so it bounds the sides of all terms
    net, terms = None, []
    for i in reversed(range(len(chain.rels))):
        rel, part = chain.rels[i], replace(chain, rels=chain.rels[i:])
        terms = [product_join(part, {**new, rel.name: change[rel.name]}, 0, few)] if rel.name in change else []
        if net is not None:
            terms.append(old[rel.name].join(net.withColumnRenamed(WEIGHT, "_w"), on_keys(rel.fk, chain.rels[i + 1].key[0])).withColumn(WEIGHT, F.col(WEIGHT) * F.col("_w")).drop("_w"))
        if terms and i:
            net = written(netted(terms), "net")
            net = None if net.isEmpty() else net
    return terms


def netted(terms: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, terms)
    return every.groupBy(*[c for c in every.columns if c != WEIGHT]).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def delta_join(chain: FkChain, old: dict[str, DataFrame], change: dict[str, DataFrame]) -> DataFrame:
    """Net signed join rows of a batch: ``old`` and ``change`` are weighted rows (``w``) of each relation.

    States need not be consolidated: joins are linear in the weights.
    """
    terms = delta_terms(chain, old, change)
    if not terms:  # nothing reached the fact table
        terms = [product_join(chain, {**old, chain.rels[0].name: old[chain.rels[0].name].limit(0)}, 0, True)]
    return netted(terms).withColumnRenamed(WEIGHT, OP)


def weighted(log: DataFrame) -> DataFrame:
    """A changelog as weighted rows."""
    return log.select(*data_columns(log), F.col(OP).cast("long").alias(WEIGHT))
