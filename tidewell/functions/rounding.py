"""Sums of money that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(amount: Column, scale: int = 8) -> Column:
    """Sum as DECIMAL(38, scale), null when nothing is summed; the same for every row order and partitioning."""
    return F.sum(amount.cast(f"decimal(28,{scale})"))


def usd(total: Column) -> Column:
    """A double with 6 decimals; null becomes 0."""
    return F.coalesce(F.round(total, 6).cast("double"), F.lit(0.0))


def round6(x: Column) -> Column:
    """A double rounded half up to 6 decimals by binary arithmetic, the same in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6
