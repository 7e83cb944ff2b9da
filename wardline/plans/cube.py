"""Aggregates kept up to date load by load: additive sums of every dimension, value and year.

A load adds a few thousand rows of counts and sums; group-bys, the overview and its totals are answered by adding these
up, without a scan of the table. Everything in a cell is a whole number, so any order of loads gives the same figures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.aggregate import DIMENSIONS
from wardline.operators.overview import long_profile, overview_of, profile_metrics

KEYS = ["dimension", "dimension_value", "in_year"]


def cells(rows: DataFrame, dimensions: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    return long_profile(rows, dimensions, by_year=True)


def add_load(rows: DataFrame, path: str, load: str, dimensions: Sequence[str] = tuple(DIMENSIONS)) -> None:
    """Store the cells of one load; storing it again replaces them. Rows must be new to the table."""
    cells(rows, dimensions).coalesce(1).write.mode("overwrite").parquet(f"{path}/load={load}")


def merged(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """``dimension, dimension_value`` with counts and sums over all loads, of the given years if any."""
    stored = spark.read.parquet(path)
    sums = [c for c in stored.columns if c not in (*KEYS, "load")]
    if years is not None:
        stored = stored.where(F.col("in_year").isin(list(years)))
    return stored.groupBy("dimension", "dimension_value").agg(*(F.sum(c).alias(c) for c in sums))


def group_by(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """Every dimension's values with the six metrics."""
    metrics = [value.alias(name) for name, value in profile_metrics().items()]
    return merged(spark, path, years).select("dimension", "dimension_value", *metrics)


def overview(spark: SparkSession, path: str) -> DataFrame:
    """The overview's rows out of the stored cells alone."""
    return overview_of(merged(spark, path))
