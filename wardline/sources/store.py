"""The stored discharge table: creation, append, full reload, identity-based insert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.schema import FACT_SCHEMA, LEDGER_SCHEMA, NAMES, PARTITION_COLUMN, RAW_SCHEMA
from wardline.session import FREED, exists, unless_set


def ddl(table: str, schema: T.StructType, partition: str | None = None, location: str | None = None) -> str:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = f" PARTITIONED BY (`{partition}`)" if partition else ""
    place = f" LOCATION '{location}'" if location else ""
    return f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{parts}{place}"


def create_tables(spark: SparkSession, prefix: str = "", location: str | None = None) -> list[str]:
    """Fact, staging and ledger tables; running it again changes nothing."""
    wanted = [
        ("inpatient_discharge", FACT_SCHEMA, PARTITION_COLUMN),
        ("inpatient_discharge_stage", RAW_SCHEMA, None),
        ("ingestion_run", LEDGER_SCHEMA, None),
    ]
    for name, schema, partition in wanted:
        place = f"{location}/{name}" if location else None
        spark.sql(ddl(prefix + name, schema, partition, place))
    return [prefix + name for name, _, _ in wanted]


def read_fact(spark: SparkSession, path: str, schema: T.StructType = FACT_SCHEMA) -> DataFrame:
    """The table with its known schema; a table not written yet is empty."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def to_fact(rows: DataFrame) -> DataFrame:
    """Table columns in order, load time added."""
    return rows.select(*NAMES, "source_rows", "row_hash", F.current_timestamp().alias("ingested_at"))


# Half of a stored row is its identity, hexadecimal text that Spark's default codec cannot make smaller.
COMPRESSION = "zstd"


def write_fact(rows: DataFrame, path: str, mode: str = "append", rebalance: bool = True) -> int:
    """Write by year and return the number of rows written. The job commits as a whole.

    Rows are brought together by year on the way, in tasks of the size that adaptive execution aims at: a year's small
    parts become one file and a large year is split. Without ``rebalance`` they are written from the grouping's own
    exchange, where every task holds rows of every year and leaves a file for each, and copies are found in small tasks.

    A file is kept open for each year. Spark otherwise sorts every task's whole rows by year first, which do not stay in memory.
    """
    rows = rows.hint("rebalance", PARTITION_COLUMN) if rebalance else rows
    seen = Observation()
    with unless_set(rows.sparkSession, FREED | SIDE_BY_SIDE | ({} if rebalance else SMALL_TASKS)):
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).partitionBy(PARTITION_COLUMN).parquet(path, compression=COMPRESSION)
    return seen.get["rows"]


# Years that a task writes side by side; it sorts only the rows that follow when it meets more.
OPEN_FILES = 32
SIDE_BY_SIDE = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}
# Text rows take ten times their file's room and hashes six times their shuffle's, so Spark's default sizes give tasks
# whose groups of hashes do not stay in memory.
SMALL_TASKS = {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def truncate(spark: SparkSession, path: str) -> None:
    """Replace the table by an empty one (explicit full reload)."""
    spark.createDataFrame([], FACT_SCHEMA).write.mode("overwrite").parquet(path)
    spark.createDataFrame([], LOADS).write.mode("overwrite").parquet(loads_path(path))


# One row a load: what its input held and what it added. The table itself cannot know the copies of rows that
# an insert found stored already.
LOADS = "rows_read long, rows_inserted long"


def loads_path(path: str) -> str:
    return path.rstrip("/") + "_loads"


def record_load(spark: SparkSession, path: str, rows_read: int, rows_inserted: int, mode: str = "append") -> None:
    spark.createDataFrame([(rows_read, rows_inserted)], LOADS).coalesce(1).write.mode(mode).parquet(loads_path(path))


def read_loads(spark: SparkSession, path: str) -> DataFrame:
    return read_fact(spark, loads_path(path), T.StructType.fromDDL(LOADS))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def refuse_if_filled(spark: SparkSession, path: str) -> None:
    """Guard against loading twice."""
    fact = read_fact(spark, path)
    if not fact.isEmpty():
        raise ValueError(f"the table already holds {fact.count():,} rows; reload it with truncate=True")


def absent_rows(new: DataFrame, stored: DataFrame, years: Sequence[int | None], as_bytes: bool = False, few: bool = False) -> DataFrame:
    """Rows of ``new`` whose identity is not stored. ``years`` are the years that occur in ``new``.

    The row hash covers the year, so only those years' hashes are read from the store. A bucketed store is joined as it
    is. For others ``as_bytes`` shuffles half as much, 32 bytes for an identity. ``few``: ``new`` is small enough to be
    sent to every task as 8 bytes a row; only stored hashes that may be among these are shuffled then.
    """
    wanted = F.col(PARTITION_COLUMN).isin([y for y in years if y is not None])
    if None in years:
        wanted = wanted | F.col(PARTITION_COLUMN).isNull()
    held = stored.where(wanted).select("row_hash")
    if few:
        short = lambda rows: F.xxhash64(rows["row_hash"])
        near = new.select(short(new).alias("_short")).distinct()
        held = held.join(F.broadcast(near), short(held) == F.col("_short"), "left_semi")
    if not as_bytes:
        return new.join(held, "row_hash", "left_anti")
    held = held.select(F.unhex("row_hash").alias("_identity"))
    rest = [c for c in new.columns if c != "row_hash"]
    return new.join(held, F.unhex("row_hash") == F.col("_identity"), "left_anti").select("row_hash", *rest)


def write_bucketed(rows: DataFrame, table: str, buckets: int, path: str) -> None:
    """The table bucketed by identity: later inserts then join it without shuffling the stored side."""
    writer = rows.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, "row_hash").sortBy("row_hash").saveAsTable(table)


def write_jdbc(rows: DataFrame, url: str, table: str, batch_size: int = 5000, **options: str) -> None:
    """Append through JDBC; commits per partition, so it is not all-or-nothing."""
    writer = rows.write.format("jdbc").mode("append").option("url", url).option("dbtable", table)
    writer.option("batchsize", batch_size).options(**options).save()
