"""Duplicate handling. Every form folds copies on the map side before its one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import bits
from wardline.functions.identity import hash_below


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str | Column] | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Keep the ``first`` or ``last`` row of each group, or none of a repeated one (``False``).

    Without ``subset`` the whole row is the key. First and last need ``order_by``: Spark files
    have no row order to rely on. ``in_place``, for whole rows of large tables with few copies: see :func:`fold_copies`.
    """
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    keys = list(subset or df.columns)
    if keep is False:
        return _drop_all_repeated(df, keys)
    if subset is None:
        return fold_copies(df, df.columns).drop("source_rows") if in_place else df.dropDuplicates()
    if not order_by:
        raise ValueError("a subset needs order_by to say which row comes first")
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranked = [c.asc_nulls_first() if keep == "first" else c.desc_nulls_last() for c in order]
    # A rank compared to a constant lets Spark cut each group to one row before the shuffle.
    window = Window.partitionBy(*keys).orderBy(*ranked)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def _drop_all_repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    aggregates = [F.count("*").alias("_copies")]
    if rest:
        # Groups of one row are the only ones kept, so any row of the group will do.
        aggregates.append(F.any_value(F.struct(*rest)).alias("_rest"))
    single = df.groupBy(*keys).agg(*aggregates).where("_copies = 1")
    return single.select(*[F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


# Places of the filter of rows that may have copies, as a power of two: 32 MB however many rows there are.
FILTER_BITS = 28


def group_copies(rows: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Distinct rows of ``columns`` with ``source_rows``, the number of copies (or the sum of ``weight``)."""
    return rows.groupBy(*columns).agg((F.count("*") if weight is None else F.sum(weight)).alias("source_rows"))


def fold_copies(rows: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """:func:`group_copies` that shuffles few rows as a whole.

    Grouping by all columns would shuffle every row. Hashes go first: a row whose hash is not met twice has no copy and
    stays where it is. The others, and the few that share a bit of the filter with them, are grouped by all columns, so
    the result does not depend on hashes being different. Copies fold before the shuffle.
    """
    place = F.col("_h").bitwiseAND(2**FILTER_BITS - 1)
    marked = rows.withColumn("_h", F.xxhash64(*columns))
    repeated = marked.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select(place.alias("place"))
    met = marked.join(F.broadcast(bits.bitmaps(repeated)), bits.bucket(place) == F.col("_bucket"), "left")
    again = bits.is_set(place)
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    single = met.where(~again).select(*columns, one.alias("source_rows"))
    return single.unionByName(group_copies(met.where(again), columns, weight))


def duplicate_rate(hashes: DataFrame, key: str = "row_hash", fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """One row: rows, distinct rows, duplicate rows and their share, judged on the row hash.

    A ``fraction`` below one gives an estimate from a sample of hashes: all copies of a row are
    in it or none, so the share is not biased the way a sample of rows would be.
    """
    hashes = hashes.where(hash_below(F.col(key), fraction, seed))
    groups = hashes.groupBy(key).agg(F.count("*").alias("n"))
    totals = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_examined"), F.count("*").alias("distinct_rows"))
    duplicates = F.col("rows_examined") - F.col("distinct_rows")
    return totals.select(
        "rows_examined",
        "distinct_rows",
        duplicates.alias("duplicate_rows"),
        F.coalesce(F.try_divide(duplicates.cast("double"), F.col("rows_examined").cast("double")), F.lit(0.0)).alias(
            "duplicate_rate"
        ),
    )
