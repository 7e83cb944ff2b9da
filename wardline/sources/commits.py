"""Loads that are seen whole or not at all: rows, rejected records and counters under one commit row.

Every load writes to folders of its own, named by its id, and at last one small commit file. Readers take the loads
that have a commit row and no others, so a load broken between its writes is invisible, and so are its rejects and
counters. Trying it again under the same id replaces what was left behind; a committed id is not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import bits
from wardline.operators.dedup import FILTER_BITS
from wardline.schema import FACT_SCHEMA, PARTITION_COLUMN
from wardline.session import FREED, unless_set
from wardline.sources import ledger
from wardline.sources.store import COMPRESSION, SIDE_BY_SIDE, read_fact

COUNTS = ("rows_read", "rows_inserted", "rows_rejected")
COMMITS = T.StructType([T.StructField("load", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("committed_at", T.TimestampType())])
REJECTS = T.StructType([T.StructField(c, T.StringType()) for c in ("load", "record", "reason")])
_FACT = T.StructType([T.StructField("load", T.StringType()), *FACT_SCHEMA.fields])


def read_commits(spark: SparkSession, target: str) -> DataFrame:
    return read_fact(spark, f"{target}/commits", COMMITS)


def _committed(spark: SparkSession, target: str) -> list[str]:
    """Ids of committed loads; a short list, one a load."""
    return [r[0] for r in read_commits(spark, target).select("load").distinct().collect()]


def read_loads(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the committed loads, with ``load``; folders of others are not opened."""
    return read_fact(spark, f"{target}/fact", _FACT).where(F.col("load").isin(_committed(spark, target)))


def read_rejects(spark: SparkSession, target: str) -> DataFrame:
    return read_fact(spark, f"{target}/rejected", REJECTS).where(F.col("load").isin(_committed(spark, target)))


def absent(rows: DataFrame, target: str) -> DataFrame:
    """``rows`` whose identity no committed load holds.

    Whole rows are shuffled only if their identity may be held: the short hashes of both sides meet first, and a bit for each
    that is met tells which rows stay where they are. ``rows`` are read three times.
    """
    held = read_loads(rows.sparkSession, target).select("row_hash")
    short = lambda df: df.select(F.xxhash64("row_hash").alias("_h"))
    place = F.col("_h").bitwiseAND(2**FILTER_BITS - 1)
    met = short(rows).join(short(held).hint("merge"), "_h", "left_semi").select(place.alias("place"))
    marked = rows.withColumn("_h", F.xxhash64("row_hash")).join(F.broadcast(bits.bitmaps(met)), bits.bucket(place) == F.col("_bucket"), "left")
    known = bits.is_set(place)
    columns = ["row_hash", *(c for c in rows.columns if c != "row_hash")]
    fresh, open_ = (marked.where(x).select(*columns) for x in (~known, known))
    return fresh.unionByName(open_.join(held, "row_hash", "left_anti"))


def load(
    spark: SparkSession, target: str, load_id: str, rows: DataFrame, rejected: DataFrame | None = None, rows_read: int | None = None, before_commit: Callable[[], None] | None = None
) -> dict:
    """Write a load and commit it; returns its commit row. ``rows`` in the table's columns, ``rejected`` (record, reason).

    ``before_commit`` runs between the writes and the commit, for checks that may still refuse the load.
    """
    if load_id in _committed(spark, target):
        raise ValueError(f"load {load_id} is committed already")
    kept, dropped = Observation(), Observation()
    out = rows.observe(kept, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("source_rows"), F.lit(0)).alias("copies"))
    with unless_set(spark, FREED | SIDE_BY_SIDE):
        out.write.mode("overwrite").partitionBy(PARTITION_COLUMN).parquet(f"{target}/fact/load={load_id}", compression=COMPRESSION)
    n_rejected = 0
    if rejected is not None:
        rejected.select("record", "reason").observe(dropped, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{target}/rejected/load={load_id}")
        n_rejected = dropped.get["n"]
    if before_commit:
        before_commit()
    read = rows_read if rows_read is not None else kept.get["copies"]
    row = (load_id, read, kept.get["n"], n_rejected, ledger.now())
    spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").parquet(f"{target}/commits")
    return dict(zip(COMMITS.fieldNames(), row, strict=True))
