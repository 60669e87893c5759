"""Money and discount texts as exact integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(text: Column) -> Column:
    """Cents of a money text: digits beyond two are cut off toward zero, a missing one counts as 0, the sign is kept."""
    return (F.trim(text).cast("decimal(24,6)") * 100).cast("bigint")


def discount_units(text: Column) -> Column:
    """A discount in ten-thousandths, rounded half up."""
    return F.round(F.trim(text).cast("decimal(24,8)") * 10000).cast("bigint")


def currency(value: Column, digits: int = 2) -> Column:
    """Cents as a text with so many digits after the point."""
    return (value.cast("decimal(24,0)") / 100).cast(f"decimal(32,{digits})").cast("string")


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0 or less."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))
