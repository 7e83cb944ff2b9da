"""Row identity: a stable hash over named columns, and order-free sampling on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# Control characters that delimited text does not hold: between values, and in place of a null.
SEPARATOR, NULL_MARK = "\x1f", "\x1e"


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as text. Nulls get a mark, so that values cannot shift places."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in columns]
    return F.sha2(F.concat_ws(SEPARATOR, *texts), 256)


def hash_below(key: Column, fraction: float, seed: int) -> Column:
    """Keep about ``fraction`` of the keys; the choice depends on the key and the seed alone."""
    if fraction >= 1:
        return F.lit(True)
    draw = F.substring(F.sha2(F.concat(key, F.lit(f":{seed}")), 256), 1, 8)
    return draw < F.lit(hex_threshold(fraction))


def hex_threshold(fraction: float) -> str:
    """The 8-digit hexadecimal bound below which that share of hashes lies."""
    return format(int(max(0.0, min(fraction, 0.9999999)) * 2**32), "08x")
