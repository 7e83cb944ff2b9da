"""Batch ingest: read, check, clean, deduplicate, write, audit.

Arguments of the job: ``--source``, ``--target``, ``--ledger``, ``--profile strict|relaxed``,
``--truncate``, ``--dry-run``, ``--multiline``, ``--most-rejects``; ``--stream`` consumes a folder as a
file stream, with ``--max-files`` per batch and at most ``--max-batches`` of them, ``--state`` with keyed state;
``--init`` creates the tables.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardline.functions.identity import row_hash
from wardline.operators import cleaning, quality
from wardline.operators.dedup import fold_copies, group_copies
from wardline.schema import NAMES, PARTITION_COLUMN, TYPED
from wardline.session import new_folder, remove_folder
from wardline.sources import ledger, readers, store

PROFILES = ("strict", "relaxed")


def as_table(relaxed: DataFrame, in_place: bool = False) -> DataFrame:
    """Relaxed rows in table types: amounts to decimals, identity added.

    Rows that differ as raw text only ("1,200" and "1200") are one row of the table, so that the identity is unique.
    """
    typed = {c: F.col(c).try_cast(t) for c, t in TYPED.items()}
    folded = (fold_copies if in_place else group_copies)(relaxed.withColumns(typed), NAMES, "source_rows")
    return folded.withColumn("row_hash", row_hash(NAMES))


def cleaned_table(raw: DataFrame, profile: str = "strict", in_place: bool = False) -> DataFrame:
    """Cleaned distinct rows. ``in_place`` is for large tables: see :func:`cleaning.strict_table`."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    if profile == "strict":
        return cleaning.strict_table(raw, in_place)
    # copies that the typed rows fold need not be folded as raw text before
    return as_table(cleaning.relaxed_copies(raw) if in_place else cleaning.relaxed_table(raw), in_place)


def years_in(raw: DataFrame, profile: str = "strict") -> list[int | None]:
    """The cleaned years that occur in raw rows: a short list, a year is a two-byte integer."""
    rows = cleaning.strict_rows(raw)
    if profile == "relaxed":
        rows = cleaning.normalize_types(cleaning.missing_tokens(raw.select(PARTITION_COLUMN)))
    return [r[0] for r in rows.select(PARTITION_COLUMN).distinct().collect()]


def reconcile(fact: DataFrame, loads: DataFrame) -> DataFrame:
    """One row: rows read by all loads, kept, dropped, and whether table and loads agree.

    Two independent counts: the loads counted their inputs and what they added, the table is counted here. The
    copies the table stands for cannot exceed what was read.
    """
    total = lambda name: loads.agg(F.coalesce(F.sum(name), F.lit(0)).alias(name)).scalar()
    held = fact.agg(F.count("*").alias("rows_inserted"), F.coalesce(F.sum("source_rows"), F.lit(0)).alias("copies"))
    both = held.select("*", total("rows_read").alias("rows_read"), total("rows_inserted").alias("told"))
    agree = (F.col("told") == F.col("rows_inserted")) & (F.col("copies") <= F.col("rows_read"))
    return both.select("rows_read", "rows_inserted", (F.col("rows_read") - F.col("rows_inserted")).alias("rows_dropped"), agree.alias("reconciled"))


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    ledger_path: str | None = None,
    *,
    fmt: str | None = None,
    profile: str = "strict",
    truncate: bool = False,
    dry_run: bool = False,
    multiline: bool = False,
    most_rejects: int = readers.MOST_REJECTS,
    quarantine: str | None = None,
    last_year: int | None = None,
    run_id: int | None = None,
    rebalance: bool = True,
) -> dict:
    """Load one file or folder into the table at ``target`` and return the counters and scores.

    ``fmt`` (csv, tsv, json) is needed where the path does not end in a known file ending. Rejected records go to
    the folder ``quarantine`` (unless given, one of this run beside the table, so no load's rejects pass for
    another's); more than ``most_rejects`` stop the load.
    """
    began = time.perf_counter()
    last_year = last_year or dt.datetime.now(dt.timezone.utc).year
    fmt = fmt or readers.source_format(source)
    marked = readers.read_source(spark, source, fmt, multiline=readers.SPLIT if multiline else False, keep_corrupt=True)
    if dry_run:
        return {**_dry_run(spark, marked, fmt, profile, last_year, most_rejects), "dry_run": True, "source": source}

    if not truncate:
        store.refuse_if_filled(spark, target)
    run = run_id if run_id is not None else int(time.time() * 1000)
    audit = {"run_id": run, "source_file": source, "started_at": ledger.now(), "source_size_bytes": store.size_of(spark, source)}
    _event(spark, ledger_path, audit, event_seq=0, status="running")
    staged = new_folder(spark, "stage")
    try:
        # The text is parsed once into a columnar staging table; every later step reads that.
        marked.write.parquet(staged)
        marked = spark.read.schema(marked.schema).parquet(staged)
        records, rejected = readers.quarantine_rejects(marked, fmt, quarantine or f"{target.rstrip('/')}_rejected/run_id={run}", most_rejects)
        raw = _good(marked, fmt)
        mode = "overwrite" if truncate else "append"
        added = store.write_fact(store.to_fact(cleaned_table(raw, profile)), target, mode, rebalance)
        store.record_load(spark, target, records - rejected, added, mode)
        fact = store.read_fact(spark, target)
        counters = reconcile(fact, store.read_loads(spark, target)).first().asDict()
        scores = _scores(raw, fact, profile, last_year)
    except Exception as error:
        _event(spark, ledger_path, audit, event_seq=2, status="failed", finished_at=ledger.now(), error=error)
        raise
    finally:
        remove_folder(spark, staged)
    done = {k: counters[k] for k in ("rows_read", "rows_inserted", "rows_dropped")}
    _event(
        spark, ledger_path, audit, event_seq=2, status="completed", finished_at=ledger.now(),
        chunks_processed=1, rows_rejected=rejected, quality=scores, **done,
    )
    elapsed = round(time.perf_counter() - began, 2)
    return {**counters, "rows_rejected": rejected, "quality": scores, "dry_run": False, "source": source,
            "run_id": run, "elapsed_seconds": elapsed}


def _dry_run(spark: SparkSession, marked: DataFrame, fmt: str, profile: str, last_year: int, most_rejects: int) -> dict:
    """Counters and scores of a load that is not written: one pass over the text, observed on its way.

    The relaxed scores are those of the raw rows, by groups of equal ones, and take a pass of their own.
    """
    read, kept = Observation(), Observation()
    seen = marked.observe(read, *readers.record_counts(marked, fmt))
    rows = cleaned_table(_good(seen, fmt), profile)
    rows.observe(kept, F.count(F.lit(1)).alias("rows"), *quality.strict_aggregates(last_year)).write.format("noop").mode("overwrite").save()
    records, rejected = read.get["records"], read.get["rejected"]
    readers.refuse_rejects(rejected, most_rejects)
    found = kept.get
    counters = {"rows_read": records - rejected, "rows_inserted": found.pop("rows"), "rows_rejected": rejected}
    counters["rows_dropped"] = counters["rows_read"] - counters["rows_inserted"]
    if profile == "strict":
        scores = spark.createDataFrame([found]).withColumn("overall", quality.overall()).first().asDict() if counters["rows_inserted"] else {**found, "overall": None}
    else:
        scores = quality.assess(cleaning.missing_tokens(_good(marked, fmt)), last_year).first().asDict()
    return {**counters, "quality": scores}


def _good(marked: DataFrame, fmt: str) -> DataFrame:
    return readers.project_canonical(readers.split_rejects(marked, fmt)[0])


def _event(spark, path, audit, **event) -> None:
    if path:
        ledger.append_event(spark, path, **audit, **event)


def _scores(raw: DataFrame, fact: DataFrame, profile: str, last_year: int) -> dict:
    """Strict scores come from the clean table, relaxed ones from the raw rows."""
    if profile == "strict":
        return quality.strict_report(fact, last_year).first().asDict()
    return quality.assess(cleaning.missing_tokens(raw), last_year).first().asDict()


def main() -> None:
    parser = argparse.ArgumentParser(description="Load discharge records into the Parquet table")
    parser.add_argument("--source", required=True)
    parser.add_argument("--target", required=True)
    parser.add_argument("--ledger")
    parser.add_argument("--format", choices=sorted(set(readers.FORMATS.values())))
    parser.add_argument("--profile", choices=PROFILES, default="strict")
    parser.add_argument("--truncate", action="store_true", help="replace the table")
    parser.add_argument("--dry-run", action="store_true", help="clean and score without writing")
    parser.add_argument("--multiline", action="store_true", help="line breaks inside quotes (in a stream: one task reads a file)")
    parser.add_argument("--most-rejects", type=int, default=readers.MOST_REJECTS)
    parser.add_argument("--stream", action="store_true", help="consume the folder as a file stream")
    parser.add_argument("--state", action="store_true", help="a stream finds copies by keyed state instead of reading the table")
    parser.add_argument("--max-files", type=int, help="files per batch of a stream")
    parser.add_argument("--max-batches", type=int, help="end a trial stream after so many batches")
    parser.add_argument("--init", action="store_true", help="create the catalog tables first")
    a = parser.parse_args()
    spark = SparkSession.builder.appName("discharge-ingest").getOrCreate()
    if a.init:
        store.create_tables(spark)
    shared = {"profile": a.profile, "multiline": a.multiline, "most_rejects": a.most_rejects}
    if a.stream and a.state:
        from wardline.streaming.state import ingest_state

        if a.profile != "strict" or a.multiline or a.max_batches:
            parser.error("--state goes with the strict profile, without --multiline and --max-batches")
        ingest_state(spark, a.source, a.target, fmt=a.format or "csv", max_files=a.max_files, most_rejects=a.most_rejects)
        result = ledger.latest_run(ledger.read_ledger(spark, f"{a.target}/ledger")).first().asDict(recursive=True)
    elif a.stream:
        from wardline.streaming.ingest import ingest_stream, read_stream_ledger

        ingest_stream(spark, a.source, a.target, fmt=a.format or "csv", max_files=a.max_files, max_batches=a.max_batches, **shared)
        result = ledger.latest_run(read_stream_ledger(spark, a.target)).first().asDict(recursive=True)
    else:
        result = ingest(spark, a.source, a.target, a.ledger, truncate=a.truncate, dry_run=a.dry_run, fmt=a.format, **shared)
    print(json.dumps(result, default=str, indent=2))


if __name__ == "__main__":
    main()
