"""Idempotent insert of new rows into the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.plans.ingest import cleaned_table, years_in
from wardline.sources import store


def rows_to_insert(raw: DataFrame, stored: DataFrame, profile: str = "strict", in_place: bool = False, few: bool = False) -> DataFrame:
    """Cleaned distinct rows of ``raw`` that the table does not hold. ``few``: see :func:`store.absent_rows`."""
    return store.absent_rows(cleaned_table(raw, profile, in_place), stored, years_in(raw, profile), in_place, few)


def insert_new(spark: SparkSession, raw: DataFrame, target: str, profile: str = "strict") -> int:
    """Append the rows the table does not hold and return how many; a second run adds none.

    Cleaning, the identity join and the append are one job, which commits as a whole and counts what it writes. The
    rows read are counted on the input; both counts go to the table's list of loads.
    """
    stored = store.read_fact(spark, target)
    added = store.write_fact(store.to_fact(rows_to_insert(raw, stored, profile, in_place=True)), target, rebalance=False)
    store.record_load(spark, target, raw.count(), added)
    return added
