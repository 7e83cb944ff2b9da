"""Where two copies of a table differ, by sums of row hashes over a two-level tree of buckets.

A bucket's sums do not depend on the order of its rows and fold before the shuffle, so comparing equal copies moves
some thousand rows however large they are. Only buckets that differ are split further, and only rows of the smallest
differing buckets are laid side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import bits

LEVELS = (3, 6)  # hexadecimal digits of the identity that name a bucket


def bucket_sums(rows: DataFrame, digits: int, identity: str = "row_hash") -> DataFrame:
    """``bucket, n, high, low, mixed``: number of rows, sums of the halves of their hashes, exclusive or of the hashes."""
    h = F.xxhash64(identity)
    parts = rows.select(F.substring(identity, 1, digits).alias("bucket"), F.shiftrightunsigned(h, 32).alias("hi"), h.bitwiseAND(F.lit(2**32 - 1)).alias("lo"), h.alias("h"))
    return parts.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("hi").alias("high"), F.sum("lo").alias("low"), F.bit_xor("h").alias("mixed"))


def differing(left: DataFrame, right: DataFrame, digits: int, identity: str = "row_hash") -> DataFrame:
    """``bucket`` for every bucket whose sums differ or that one side lacks."""
    a, b = bucket_sums(left, digits, identity), bucket_sums(right, digits, identity)
    both = a.alias("a").join(b.alias("b"), "bucket", "full")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "high", "low", "mixed")]
    return both.where(~(same[0] & same[1] & same[2] & same[3])).select("bucket")


def _within(rows: DataFrame, buckets: DataFrame, digits: int, identity: str) -> DataFrame:
    return rows.join(buckets, F.substring(identity, 1, digits) == F.col("bucket"), "left_semi")


def _within_bits(rows: DataFrame, buckets: DataFrame, digits: int, identity: str) -> DataFrame:
    """Rows of the named buckets. A bit for each bucket (2 MB for six digits) is sent to the rows, which stay in place."""
    place = lambda name: F.conv(name, 16, 10).cast("long")
    spot = place(F.substring(identity, 1, digits))
    met = rows.join(F.broadcast(bits.bitmaps(buckets.select(place(F.col("bucket")).alias("place")))), bits.bucket(spot) == F.col("_bucket"))
    return met.where(bits.is_set(spot)).select(*rows.columns)


def difference(left: DataFrame, right: DataFrame, show: Sequence[str] = (), identity: str = "row_hash") -> DataFrame:
    """``identity``, ``show``, ``side`` (left or right) and ``times`` for rows that one copy holds more often.

    A changed row has another identity, so it is one row of either side. Rows without identity take no part.
    """
    first, second = LEVELS
    top = F.broadcast(differing(left, right, first, identity))  # at most 16 ** 3 short names
    here = [_within(side, top, first, identity) for side in (left, right)]
    opened = differing(*here, second, identity)
    counts = []
    for sign, side in zip((1, -1), here, strict=True):
        rows = _within_bits(side, opened, second, identity).groupBy(identity).agg(*(F.min(c).alias(c) for c in show), F.count("*").alias("n"))
        counts.append(rows.withColumn("n", F.col("n") * sign))
    net = counts[0].unionByName(counts[1]).groupBy(identity).agg(*(F.min(c).alias(c) for c in show), F.sum("n").alias("net")).where("net <> 0")
    return net.select(identity, *show, F.when(F.col("net") > 0, "left").otherwise("right").alias("side"), F.abs("net").alias("times"))
