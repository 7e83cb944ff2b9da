"""Incremental ingest of a folder of text files as a file stream.

Every micro-batch writes its own ``batch_id=`` folders in overwrite mode, so a replayed batch
leaves the same state behind. Rows are matched by identity against earlier batches only.

The ledger has one run a call: ``running`` at the start and after every batch, at last ``completed`` or ``failed``.
"""

from __future__ import annotations

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators import cleaning, quality
from wardline.plans.incremental import rows_to_insert
from wardline.schema import FACT_SCHEMA, LEDGER_SCHEMA, PARTITION_COLUMN
from wardline.session import FREED, new_folder, remove_folder, unless_set
from wardline.sources import ledger, readers, store

SUMS = T.StructType([T.StructField(n, T.LongType()) for n in (*quality.SUM_COLUMNS, "batch_id")])
STREAM_FACT = T.StructType(FACT_SCHEMA.fields + [T.StructField("batch_id", T.LongType())])


# Rows of a batch up to which its identities are sent to every task (8 bytes each) to pick out the stored ones.
FEW_ROWS = 2_000_000


class BatchCapReached(Exception):
    """Raised inside a batch beyond the cap; that batch stays unread for the next run."""


def read_stream(
    spark: SparkSession, folder: str, fmt: str = "csv", max_files: int | None = None, multiline: bool = False
) -> DataFrame:
    """Text stream under the column contract; the first file's header is the schema."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "json":
        return readers.json_records(reader.text(folder))
    columns = readers.csv_header(spark, folder, fmt, multiline)
    readers.validate_columns(columns)
    options = {**readers.csv_options(fmt, multiline), "enforceSchema": False}
    return reader.options(**options).schema(readers.text_schema(columns, corrupt=True)).csv(folder)


def read_stream_fact(spark: SparkSession, target: str) -> DataFrame:
    return store.read_fact(spark, f"{target}/fact", STREAM_FACT)


def read_sums(spark: SparkSession, target: str) -> DataFrame:
    return store.read_fact(spark, f"{target}/quality", SUMS)


def read_stream_ledger(spark: SparkSession, target: str) -> DataFrame:
    schema = T.StructType(LEDGER_SCHEMA.fields + [T.StructField("batch_id", T.LongType())])
    return store.read_fact(spark, f"{target}/ledger", schema).drop("batch_id")


def process_batch(
    batch: DataFrame,
    batch_id: int,
    target: str,
    *,
    fmt: str = "csv",
    profile: str = "strict",
    last_year: int,
    most_rejects: int = readers.MOST_REJECTS,
    audit: dict | None = None,
) -> dict:
    """One micro-batch: set rejects aside, score the raw rows, write the rows not stored yet, append the event.

    Returns the counters of all batches so far. They are those of the event before plus this batch's, so no earlier
    row is counted again.
    """
    spark = batch.sparkSession
    staged = new_folder(spark, "batch")
    try:
        with unless_set(spark, FREED):
            # The text is parsed once into columns, which each job reads as it needs them. A compressed file is one task's;
            # what follows the parsing is dealt to all of them.
            batch.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{staged}/text")
            batch = spark.read.schema(batch.schema).parquet(f"{staged}/text")
            records, rejected = readers.quarantine_rejects(batch, fmt, f"{target}/rejected/batch_id={batch_id}", most_rejects)
            raw = readers.project_canonical(readers.split_rejects(batch, fmt)[0])

            def score() -> None:
                sums = quality.quality_sums(cleaning.missing_tokens(raw), last_year)
                sums.write.mode("overwrite").parquet(f"{target}/quality/batch_id={batch_id}")

            def insert() -> int:
                earlier = read_stream_fact(spark, target).where(F.col("batch_id") < batch_id)
                new = store.to_fact(rows_to_insert(raw, earlier, profile, few=records <= FEW_ROWS))
                return store.write_fact(new, f"{target}/fact/batch_id={batch_id}", "overwrite")

            # Neither needs the other; planning the one fills the time in which the other runs.
            with ThreadPoolExecutor(1) as beside:
                scored = beside.submit(inheritable_thread_target(spark)(score))
                added = insert()
                scored.result()
    finally:
        remove_folder(spark, staged)
    before = _counters_before(spark, target, batch_id)
    counters = {
        "chunks_processed": before["chunks_processed"] + 1,
        "rows_read": before["rows_read"] + records - rejected,
        "rows_inserted": before["rows_inserted"] + added,
        "rows_rejected": before["rows_rejected"] + rejected,
    }
    counters["rows_dropped"] = counters["rows_read"] - counters["rows_inserted"]
    audit = audit or {"run_id": 1, "started_at": ledger.now()}
    ledger.append_event(spark, f"{target}/ledger/batch_id={batch_id}", mode="overwrite", event_seq=batch_id + 1, status="running", **audit, **counters)
    return counters


COUNTERS = ("chunks_processed", "rows_read", "rows_inserted", "rows_dropped", "rows_rejected")


def _counters_before(spark: SparkSession, target: str, batch_id: int | None = None) -> dict:
    """Counters of the latest batch event, or of the latest before ``batch_id``."""
    schema = T.StructType(LEDGER_SCHEMA.fields + [T.StructField("batch_id", T.LongType())])
    events = store.read_fact(spark, f"{target}/ledger", schema).where("batch_id >= 0")
    if batch_id is not None:
        events = events.where(F.col("batch_id") < batch_id)
    last = events.orderBy(F.desc("batch_id")).select(*COUNTERS, "batch_id").first()
    return {c: (last[c] or 0) if last else 0 for c in (*COUNTERS, "batch_id")}


def ingest_stream(
    spark: SparkSession,
    folder: str,
    target: str,
    *,
    fmt: str = "csv",
    profile: str = "strict",
    max_files: int | None = None,
    max_batches: int | None = None,
    last_year: int | None = None,
    multiline: bool = False,
    most_rejects: int = readers.MOST_REJECTS,
    run_id: int | None = None,
) -> DataFrame:
    """Consume what is there, then stop; a later call continues behind the checkpoint.

    ``max_batches`` ends the run early for trials. A batch with more than ``most_rejects`` rejected records fails
    the run. Returns the table so far.
    """
    last_year = last_year or dt.datetime.now(dt.timezone.utc).year
    done = [0]
    audit = {
        "run_id": run_id if run_id is not None else int(time.time() * 1000), "source_file": folder,
        "source_size_bytes": store.size_of(spark, folder), "started_at": ledger.now(),
    }

    def event(seq: int, **values: object) -> None:
        ledger.append_event(spark, f"{target}/ledger/batch_id=-1", event_seq=seq, **audit, **values)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if max_batches is not None and done[0] >= max_batches:
            raise BatchCapReached(f"stopped after {max_batches} batches")
        process_batch(
            batch, batch_id, target, fmt=fmt, profile=profile, last_year=last_year, most_rejects=most_rejects, audit=audit
        )
        done[0] += 1

    stream = read_stream(spark, folder, fmt, max_files, multiline)
    event(0, status="running")
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{target}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception as error:
        if "BatchCapReached" not in str(error):
            reached = _counters_before(spark, target)
            event(reached.pop("batch_id") + 2, status="failed", finished_at=ledger.now(), error=error, **reached)
            raise
    reached = _counters_before(spark, target)
    scores = _scores(spark, target, profile, last_year)
    event(reached.pop("batch_id") + 2, status="completed", finished_at=ledger.now(), quality=scores, **reached)
    return read_stream_fact(spark, target)


def _scores(spark: SparkSession, target: str, profile: str, last_year: int) -> dict:
    """The profile's own scores, as a batch load has them: strict over the clean table, relaxed over the raw rows."""
    if profile == "strict":
        return quality.strict_report(read_stream_fact(spark, target), last_year).first().asDict()
    return total_quality(spark, target).first().asDict()


def total_quality(spark: SparkSession, target: str) -> DataFrame:
    """Scores over all batches; the four means equal those of the whole source."""
    return quality.report(quality.merge_sums(read_sums(spark, target)))
