"""Rounded averages that do not depend on the order of summation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_avg(value: Column, digits: int) -> Column:
    """Average rounded half up at ``digits`` decimals; NULL for a group without values.

    Rounding jumps at half a cent, so a last-bit difference between two summation orders could show.
    The sum is therefore taken over decimals (inputs fixed at 6 places), which add up exactly in any
    order. A group with a reading that no decimal(28,6) holds (NaN, infinities, beyond 22 digits) has its
    plain average rounded; NaN, infinities and averages too large to have decimals are kept as they are.
    """
    scale = float(10**digits)
    exact = value.try_cast("decimal(28,6)")
    mean = F.sum(exact).cast("double") / F.nullif(F.count(value), F.lit(0))
    mean = F.when(F.count(exact) == F.count(value), mean).otherwise(F.avg(value))
    return F.when(F.abs(mean * scale) < 1e15, F.floor(mean * scale + 0.5) / scale).otherwise(mean)
