"""Incremental ingest whose duplicates are found by keyed state instead of the stored table.

Identities seen so far live in the stream's state store (RocksDB: on the executors' disks, with changes written to the
checkpoint), dealt by identity. A batch looks up its own identities there and reads nothing of the table, so its cost
does not grow with what is stored. The file sink commits a batch as a whole; a replayed batch is not written twice.

Counters come from the stream's own metrics, observed while the rows pass. Rejected records are counted there too, and
written out by a second, stateless pass only if there were any. The ledger has an event for every batch.
"""

from __future__ import annotations

import time

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.functions.identity import row_hash
from wardline.operators import cleaning
from wardline.schema import NAMES, PARTITION_COLUMN
from wardline.sources import ledger, readers, store
from wardline.streaming.ingest import read_stream

SETTINGS = {
    # The checkpoint takes each batch's changes instead of whole files of the store, and versions that no restart reads go.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.numRecentProgressUpdates": "100000",  # one small record a batch: the counters of a whole call
}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """``SETTINGS`` while a stream is started; it keeps them."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def distinct_stream(raw: DataFrame) -> DataFrame:
    """Strict rows of a stream with their identity, each identity once over the life of the checkpoint.

    A row that comes again is dropped, whichever batch it is in; so a row stands for itself and not for its copies.
    """
    rows = cleaning.strict_rows(raw).select(*NAMES).withColumn("_identity", F.unhex(row_hash(NAMES)))
    return rows.dropDuplicates(["_identity"]).select(*NAMES, F.lower(F.hex("_identity")).alias("row_hash"))


def _counted(marked: DataFrame, fmt: str) -> DataFrame:
    """Good rows of a marked stream; all and rejected records are observed as ``read``."""
    reason = readers.reject_reason(fmt, len(marked.columns) - 1).isNotNull()
    bad = F.col(readers.CORRUPT).isNotNull() & reason
    seen = marked.observe("read", F.count(F.lit(1)).alias("records"), F.count(F.when(bad, 1)).alias("rejected"))
    return readers.project_canonical(readers.split_rejects(seen, fmt)[0])


def _run(query: StreamingQuery) -> list[dict]:
    """Metrics of each batch of a query that ends by itself."""
    query.awaitTermination()
    out = []
    for p in query.recentProgress:
        read, kept = p.observedMetrics.get("read"), p.observedMetrics.get("kept")
        if read is not None:
            out.append({"batch_id": p.batchId, "records": read["records"], "rejected": read["rejected"], "inserted": kept["rows"] if kept else 0})
    return out


def ingest_state(
    spark: SparkSession,
    folder: str,
    target: str,
    *,
    fmt: str = "csv",
    max_files: int | None = None,
    most_rejects: int = readers.MOST_REJECTS,
    run_id: int | None = None,
) -> DataFrame:
    """Consume what is in ``folder``, then stop; a later call continues behind the checkpoint, with the state kept there.

    More than ``most_rejects`` rejected records in a call fail it after the good rows are written; the records are in
    ``<target>/rejected``. Returns the table so far.
    """
    run = {"run_id": run_id if run_id is not None else int(time.time() * 1000), "source_file": folder, "started_at": ledger.now()}
    book = f"{target}/ledger"
    ledger.append_event(spark, book, event_seq=0, status="running", **run)
    try:
        rows = store.to_fact(distinct_stream(_counted(read_stream(spark, folder, fmt, max_files), fmt)).withColumn("source_rows", F.lit(1).cast("long")))
        writer = rows.observe("kept", F.count(F.lit(1)).alias("rows")).writeStream.format("parquet").outputMode("append").partitionBy(PARTITION_COLUMN).option("compression", store.COMPRESSION)
        with _settings(spark):
            query = writer.option("path", f"{target}/fact").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
        batches = _run(query)
        total = {"rows_read": 0, "rows_inserted": 0, "rows_rejected": 0}
        for number, batch in enumerate(batches, 1):
            total["rows_read"] += batch["records"] - batch["rejected"]
            total["rows_inserted"] += batch["inserted"]
            total["rows_rejected"] += batch["rejected"]
            counters = {**total, "rows_dropped": total["rows_read"] - total["rows_inserted"], "chunks_processed": number}
            ledger.append_event(spark, book, event_seq=number, status="running", **run, **counters)
        if total["rows_rejected"]:
            _set_aside(spark, folder, target, fmt)
        if total["rows_rejected"] > most_rejects:
            raise ValueError(f"{total['rows_rejected']} bad records, at most {most_rejects} are tolerated, kept in {target}/rejected")
    except Exception as error:
        ledger.append_event(spark, book, event_seq=10**6, status="failed", finished_at=ledger.now(), error=error, **run)
        raise
    total["rows_dropped"] = total["rows_read"] - total["rows_inserted"]
    ledger.append_event(spark, book, event_seq=len(batches) + 1, status="completed", finished_at=ledger.now(), chunks_processed=len(batches), **run, **total)
    return read_table(spark, target)


def _set_aside(spark: SparkSession, folder: str, target: str, fmt: str) -> None:
    rejected = readers.split_rejects(read_stream(spark, folder, fmt), fmt)[1]
    writer = rejected.writeStream.format("parquet").outputMode("append").option("path", f"{target}/rejected")
    writer.option("checkpointLocation", f"{target}/rejected_checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_table(spark: SparkSession, target: str) -> DataFrame:
    """The table of a stream; only batches that were committed are in it."""
    return store.read_fact(spark, f"{target}/fact")
