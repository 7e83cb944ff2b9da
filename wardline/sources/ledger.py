"""Audit ledger: an append-only event table; a run's state is its latest event."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import text as X
from wardline.schema import LEDGER_SCHEMA, QUALITY_SCHEMA
from wardline.sources.store import read_fact

ERROR_LENGTH = 2000
STATUSES = ("running", "completed", "failed")


def append_event(spark: SparkSession, path: str, *, mode: str = "append", **event: object) -> None:
    """Write one event; ``quality`` is a dict and becomes JSON, errors are cut to 2,000 characters."""
    if event.get("status") not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    quality = event.pop("quality", None)
    event["quality_json"] = json.dumps(quality) if quality else None
    event["error_message"] = (str(event.pop("error", None) or ""))[:ERROR_LENGTH] or None
    row = tuple(event.get(f.name) for f in LEDGER_SCHEMA)
    spark.createDataFrame([row], LEDGER_SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_fact(spark, path, LEDGER_SCHEMA)


def latest_per_run(events: DataFrame) -> DataFrame:
    """State of every run: the event with the highest sequence number; partial results fold early."""
    rest = [c for c in events.columns if c != "run_id"]
    order = F.struct(*[c for c in ("event_seq",) if c in rest])
    state = events.groupBy("run_id").agg(F.max_by(F.struct(*rest), order).alias("s"))
    return state.select("run_id", "s.*")


def decode_quality(quality_json: Column) -> Column:
    return F.from_json(quality_json, QUALITY_SCHEMA.simpleString())


def latest_run(events: DataFrame) -> DataFrame:
    """The newest run: ISO times, decoded quality. Only its own events take part."""
    newest = events.agg(F.max("run_id").alias("m")).scalar()
    state = latest_per_run(events.where(F.col("run_id") == newest))
    return state.withColumns(
        {
            "started_at": X.iso_time(F.col("started_at")),
            "finished_at": X.iso_time(F.col("finished_at")),
            "quality": decode_quality(F.col("quality_json")),
        }
    ).drop("quality_json")
