"""Where snapshots go: formatted CSV, numbered folders, nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import currency


def formatted(rows: DataFrame, acctbal: str = "c_acctbal") -> DataFrame:
    """Revenue with four and balance with two digits, as texts."""
    exact = lambda c, n: F.col(c).cast(f"decimal(32,{n})").cast("string")
    return rows.withColumns({"revenue": exact("revenue", 4), **({acctbal: exact(acctbal, 2)} if acctbal in rows.columns else {})})


def from_cents(rows: DataFrame, column: str, digits: int = 2) -> DataFrame:
    return rows.withColumn(column, currency(F.col(column), digits))


def quoted(column: str):
    """A text in quotes, quotes within doubled."""
    return F.concat(F.lit('"'), F.replace(F.col(column), F.lit('"'), F.lit('""')), F.lit('"'))


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header; for rankings of a few rows."""
    formatted(rows).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_snapshot(rows: DataFrame, path: str, trigger: str, number: int) -> None:
    """A numbered snapshot; writing it again replaces it."""
    write_csv(rows, f"{path}/trigger={trigger.lower()}/snapshot={number}")


def discard(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()
