"""Sets of small whole numbers as bitmaps: a table of at most some MB that can be sent to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15  # places in a bitmap, as a power of two: what Spark's aggregate builds


def bucket(place: Column) -> Column:
    return F.shiftright(place, BITS)


def _bit(place: Column) -> Column:
    return place.bitwiseAND(2**BITS - 1)


def bitmaps(places: DataFrame, name: str = "place") -> DataFrame:
    """``_bucket, _bits`` of the places (not negative) that occur in ``places``."""
    return places.select(bucket(F.col(name)).alias("_bucket"), _bit(F.col(name)).alias("bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("bit").alias("_bits"))


def is_set(place: Column, held: str = "_bits") -> Column:
    """Whether the bitmap of the place's bucket, null if there is none, holds it."""
    bit = _bit(place)
    byte = F.conv(F.hex(F.substring(held, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False))
