"""Exact order statistics of a whole table by narrowing histograms, without a global sort.

Every round counts the rows of a few hundred buckets (a partial aggregate: the shuffle carries buckets, not rows) and
goes on inside the bucket that holds the wanted place, until few rows are left there to be looked at themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
FEW = 10_000


def kth_smallest(rows: DataFrame, value: Column, k: int) -> int:
    """The ``k``-th smallest (from 1) of a whole-number column; nulls take no part."""
    numbers = rows.select(value.cast("long").alias("v")).where("v is not null")
    low, high, total = numbers.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not 1 <= k <= total:
        raise ValueError(f"place {k} of {total} rows")
    while True:
        inside = numbers.where(F.col("v").between(low, high))
        if total <= FEW or low == high:
            return low if low == high else inside.orderBy("v").limit(k).agg(F.max("v")).first()[0]
        width = (high - low) // BUCKETS + 1
        bucket = F.floor((F.col("v") - low) / width).cast("long") if high - low < 2**52 else F.expr(f"(v - {low}L) div {width}L")
        for number, n in sorted(map(tuple, inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())):
            if k <= n:
                low, high, total = low + number * width, min(high, low + (number + 1) * width - 1), n
                break
            k -= n


def median(rows: DataFrame, value: Column) -> float | None:
    """The exact median of a whole-number column: of an even number of rows the mean of the two in the middle."""
    n = rows.select(F.count(value)).first()[0]
    if n == 0:
        return None
    upper = kth_smallest(rows, value, n // 2 + 1)
    return float(upper) if n % 2 else (kth_smallest(rows, value, n // 2) + upper) / 2


def draw_below(rows: DataFrame, draw: Column, k: int, digits: int = 3) -> str | None:
    """The ``k``-th smallest of a column of equally long hexadecimal draws; None if there are not more than ``k`` rows.

    The histogram is over the next ``digits`` hexadecimal digits; draws are uniform, so each round divides by 16 to
    that power what is left to look at.
    """
    drawn = rows.select(draw.alias("d")).where("d is not null")
    prefix, left = "", drawn.count()
    if left <= k:
        return None
    while left > FEW:
        at = F.substring("d", len(prefix) + 1, digits)
        inside = drawn.where(F.col("d").startswith(prefix))
        for part, n in sorted(map(tuple, inside.groupBy(at.alias("p")).agg(F.count("*").alias("n")).collect())):
            if k <= n:
                prefix, left = prefix + part, n
                break
            k -= n
        if len(prefix) >= 64:
            return prefix
    return drawn.where(F.col("d").startswith(prefix)).orderBy("d").limit(k).agg(F.max("d")).first()[0]
