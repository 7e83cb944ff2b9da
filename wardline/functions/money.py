"""Exact sums of amounts in primitive arithmetic.

Summing ``decimal(14,2)`` widens every addition to a 24-digit decimal object. An amount in cents
fits a long; split into a high and a low part, both sums stay longs (9 trillion rows for the low
part), are exact in any order and cost half as much.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 20


def cents(name: str) -> Column:
    return (F.col(name).cast("decimal(14,2)") * 100).cast("bigint")


def high(c: Column) -> Column:
    return F.shiftright(c, _BITS)


def low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(2**_BITS - 1))


def joined(high_sum: Column, low_sum: Column) -> Column:
    """The amount as double out of the two sums, rounded once."""
    whole = high_sum.cast("decimal(20,0)") * F.lit(2**_BITS).cast("decimal(8,0)") + low_sum.cast("decimal(20,0)")
    return (whole * F.lit("0.01").cast("decimal(3,2)")).cast("double")


def exact_sum(name: str) -> Column:
    """Aggregate: the sum of an amount column as double; null for a group without amounts."""
    return joined(F.sum(high(cents(name))), F.sum(low(cents(name))))


def exact_mean(name: str) -> Column:
    return F.try_divide(exact_sum(name), F.count(name).cast("double"))
