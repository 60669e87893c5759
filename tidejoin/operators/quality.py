"""Integrity checks: keys, references, nulls and lengths."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pk_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """``key, n`` of the keys that more than one row has; columns of a composite key stay apart."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows that refer to a missing row; a null refers to nothing and is no orphan."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("_pk")).distinct(), F.col(fk) == F.col("_pk"), "left_anti")


def integrity(tables: dict[str, DataFrame], keys: list[tuple[str, list[str]]], references: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """``relation, constraint, n_bad`` for each primary key (relation, columns) and foreign key (child, column, parent, its key)."""
    found = [(n, "pk " + ",".join(k), pk_duplicates(tables[n], k)) for n, k in keys]
    found += [(c, f"fk {fk}", fk_orphans(tables[c], fk, tables[p], pk)) for c, fk, p, pk in references]
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_bad")).select(F.lit(n).alias("relation"), F.lit(c).alias("constraint"), "n_bad") for n, c, df in found])


def column_checks(df: DataFrame, not_null: list[str], lengths: dict[str, int]) -> DataFrame:
    """``column, n_null, max_length, ok``, from one pass over the table."""
    columns = list(dict.fromkeys([*not_null, *lengths]))
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), (F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)) if c in lengths else F.lit(None).cast("int")).alias("max_length"), F.lit(lengths.get(c)).cast("int").alias("limit"), F.lit(c in not_null).alias("required")).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = one.select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))
    ok = (~F.col("required") | (F.col("n_null") == 0)) & (F.col("limit").isNull() | (F.col("max_length") <= F.col("limit")))
    return rows.select("column", "n_null", "max_length", ok.alias("ok"))
