"""The staged text table and the strict fact table of a data folder, written once per session."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import fixtures
from wardline.operators.cleaning import strict_table
from wardline.schema import COLUMNS, RAW_SCHEMA
from wardline.session import FREED, new_folder, unless_set
from wardline.sources import store

_written: dict[tuple, str] = {}


def _signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Number, size and newest change of the input files; file contents are not read."""
    paths = [f"{sf_dir}/{name}.parquet" for name in fixtures.TABLES]
    if all(os.path.isfile(p) for p in paths):
        stats = [os.stat(p) for p in paths]
        return tuple((s.st_size, s.st_mtime_ns) for s in stats)
    files = spark.read.format("binaryFile").load(paths)
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime")).first())


def _once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name, _signature(spark, sf_dir))
    if key not in _written:
        path = new_folder(spark, name)
        with unless_set(spark, FREED):
            write(path)
        _written[key] = path
    return _written[key]


def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 33 text columns as a columnar staging table: joined once, read by many."""
    path = _once(spark, sf_dir, "stage", lambda p: fixtures.discharge_raw(spark, sf_dir).write.parquet(p, compression=store.COMPRESSION))
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def fact_path(spark: SparkSession, sf_dir: str) -> str:
    def write(path: str) -> None:
        rows = store.to_fact(strict_table(stage(spark, sf_dir), in_place=True))
        added = store.write_fact(rows, path, rebalance=False)
        store.record_load(spark, path, stage(spark, sf_dir).count(), added, "overwrite")

    return _once(spark, sf_dir, "fact", write)


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_loads(spark, fact_path(spark, sf_dir))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict discharge table, partitioned by year."""
    return store.read_fact(spark, fact_path(spark, sf_dir))


# Records per exported file. The files are compressed, so each is one task's; the text is some ten times as large.
RECORDS_PER_FILE = 250_000
TEXT_FILES = {"compression": "gzip", "maxRecordsPerFile": RECORDS_PER_FILE}


def csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """The staged rows as CSV files with the source headers."""
    rows = stage(spark, sf_dir)

    def write(path: str) -> None:
        out = rows.withColumnsRenamed({n: h for h, n in COLUMNS})
        writer = out.write.options(**TEXT_FILES).option("header", True).option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)

    return _once(spark, sf_dir, "csv", write)


def json_folder(spark: SparkSession, sf_dir: str) -> str:
    """The staged rows as JSON lines with the source headers."""
    rows = stage(spark, sf_dir)
    return _once(
        spark, sf_dir, "jsonl", lambda p: rows.withColumnsRenamed({n: h for h, n in COLUMNS}).write.options(**TEXT_FILES).json(p)
    )
