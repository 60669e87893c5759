"""Revenue of a line from its price and discount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(price: Column, discount: Column) -> Column:
    """price * (1 - discount), DECIMAL(32,4): nothing is rounded."""
    return price.cast("decimal(15,2)") * (F.lit(1).cast("decimal(1,0)") - discount.cast("decimal(15,2)"))


def truncated_cents(price: Column, discount: Column) -> Column:
    """Cents as a long, where the discount is cut off to a cent."""
    p = (price.cast("decimal(15,2)") * 100).cast("bigint")
    bp = F.round(discount.cast("decimal(17,4)") * 10000).cast("bigint")
    return p - F.call_function("div", p * bp, F.lit(10000).cast("bigint"))


MODES = {"exact": exact, "cents": truncated_cents}
