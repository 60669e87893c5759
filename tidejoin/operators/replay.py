"""All join deltas of a bounded changelog at once, by joining versions whose lives overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.chain import FkChain
from .changelog import BATCH, OP, data_columns, net_changes
from .fk_join import on_keys, small

#: End of a version that is still there.
FOREVER = 2**62
#: Facts of one foreign key from which on their join is left to be split.
HOT_ROWS = 1_000_000
#: Changes of facts that a task nets and joins; so many that its memory doesn't depend on the input.
TASK_ROWS = 100_000


def row_versions(log: DataFrame, dealt_by: str | None = None, parts: int | None = None) -> DataFrame:
    """Rows with ``m`` copies from batch ``from_batch`` until before ``to_batch``.

    If the log is dealt by a column first, the sums, the windows and a join on that column all stay in place; ``parts``: in
    so many partitions, which Spark doesn't merge.

    The k-th insert of a row pairs with its k-th delete; copies are counted, not listed, so a row that comes
    a million times is one row here.
    """
    columns = data_columns(log)
    if dealt_by:
        log = log.repartition(parts, dealt_by) if parts else log.repartition(dealt_by)
    w = Window.partitionBy(*columns).orderBy(BATCH)
    net = net_changes(log)
    v = net.select(*columns, F.col(BATCH).alias("from_batch"), F.coalesce(F.lead(BATCH).over(w), F.lit(FOREVER)).alias("to_batch"), F.sum(OP).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("m"))
    return v.where("m <> 0")


def hottest(log: DataFrame, key: str) -> int:
    """A bound of the number of rows of the most frequent key, from a sketch that tasks merge: no row is shuffled."""
    found = log.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, 1, 10000)").alias("top")).first()[0]
    return max((r["count"] for r in found or []), default=0)


def joined_versions(chain: FkChain, logs: dict[str, DataFrame], hot_rows: int = HOT_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Join rows of the chain with the batches of their lives; foreign keys are the equi-join, overlap the rest.

    Facts are dealt by their foreign key once, ``task_rows`` to a task, and netting, versions and the first join stay there, unless a key has more
    than ``hot_rows`` facts: then rows are netted where they fall by all of their columns, and the joins get exchanges of
    their own, which Spark splits at run time where a key is too large.  The last dimension is broadcast if it is small.
    """
    last = chain.rels[-1].name
    even, parts = hottest(logs[chain.fact.name], chain.fact.fk) <= hot_rows, None
    if even:  # sorts and sums take some tens of times the bytes of a shuffle, so rows are counted
        parts = max(logs[r.name].count() for r in chain.rels[:2]) // task_rows + 1

    def step(left: DataFrame, pair) -> DataFrame:
        a, b = pair
        right = row_versions(logs[b.name], b.key[0] if even and b.name != last else None, parts if a is chain.fact else None)
        # each change of the log makes one version at most
        right = (small(right, logs[b.name]) if b.name == last else right).withColumnsRenamed({"from_batch": "_from", "to_batch": "_to", "m": "_m"})
        meet = on_keys(a.fk, b.key[0]) & (F.greatest("from_batch", "_from") < F.least("to_batch", "_to"))
        both = left.join(right, meet)
        return both.withColumns({"from_batch": F.greatest("from_batch", "_from"), "to_batch": F.least("to_batch", "_to"), "m": F.col("m") * F.col("_m")}).drop("_from", "_to", "_m")

    return reduce(step, chain.pairs(), row_versions(logs[chain.fact.name], chain.fact.fk if even else None, parts))


def signed(v: DataFrame, columns: list[str]) -> DataFrame:
    """Both ends of the lives of versions: copies that come and copies that go."""
    ends = F.array(F.struct(F.col("from_batch").alias(BATCH), F.col("m").alias(OP)), F.struct(F.col("to_batch").alias(BATCH), (-F.col("m")).alias(OP)))
    return v.select(*columns, F.inline(ends)).where(F.col(BATCH) < FOREVER).select(*columns, OP, BATCH)


def join_deltas(chain: FkChain, logs: dict[str, DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Signed join rows: all columns, ``op`` (the change of the number of copies), ``batch``."""
    v = joined_versions(chain, logs, hot_rows)
    return net_changes(signed(v, [c for c in v.columns if c not in ("from_batch", "to_batch", "m")]))


def narrowed(chain: FkChain, logs: dict[str, DataFrame], measured: list[str]) -> dict[str, DataFrame]:
    """The changelogs with keys and measured columns alone: sums over join deltas need no others, as weights add up."""
    columns = lambda r: dict.fromkeys([*(measured if r is chain.fact else r.key), *([r.fk] if r.fk else [])])
    return {r.name: logs[r.name].select(*columns(r), OP, BATCH) for r in chain.rels}


def signed_groups(chain: FkChain, logs: dict[str, DataFrame]) -> DataFrame:
    """``group key, revenue, cnt``: the view after a whole changelog, from keys and measures alone.

    Sums don't need the lives of rows, only their weights at the end, and no column but keys and measure: relations are
    reduced to those first, and summed by the first foreign key before anything is joined.
    """
    fact, rest = chain.fact, chain.rels[1:]
    key = fact.fk
    at = logs[fact.name].groupBy(key).agg(F.sum(chain.measure() * F.col(OP)).alias("revenue"), F.sum(OP).cast("long").alias("cnt")).where("cnt <> 0 or revenue <> 0")
    for rel in rest:
        keep = [rel.key[0], *([rel.fk] if rel.fk else [])]
        weights = logs[rel.name].groupBy(*keep).agg(F.sum(OP).cast("long").alias("_w")).where("_w <> 0")
        weights = small(weights) if rel is rest[-1] else weights
        at = at.join(weights, on_keys(key, rel.key[0]))
        at = at.select(*[c for c in at.columns if c not in ("revenue", "cnt", "_w")], (F.col("revenue") * F.col("_w").cast("decimal(19,0)")).cast("decimal(38,4)").alias("revenue"), (F.col("cnt") * F.col("_w")).alias("cnt"))
        if rel.fk:
            more = [chain.group_key] if chain.group_key in at.columns else []
            at = at.groupBy(*dict.fromkeys([rel.fk, *more])).agg(F.sum("revenue").alias("revenue"), F.sum("cnt").alias("cnt"))
            key = rel.fk
    return at.groupBy(chain.group_key).agg(F.sum("revenue").cast("decimal(38,4)").alias("revenue"), F.sum("cnt").alias("cnt")).where("cnt > 0")


def delta_counts(deltas: DataFrame) -> DataFrame:
    """``batch, op, n``: inserted (1) and retracted (-1) join rows of each batch."""
    return deltas.groupBy(BATCH, F.signum(OP).cast("int").alias(OP)).agg(F.sum(F.abs(OP)).alias("n"))
