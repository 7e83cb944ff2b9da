"""Delimited and JSON-lines sources, read as text under the 33-column contract."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from wardline.schema import CLEAN_SCHEMA, HEADER_TO_NAME, HEADERS, NAMES
from wardline.sources import multiline as split_lines

# Accepted file endings.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "json"}
SEPARATORS = {"csv": ",", "tsv": "\t"}
CORRUPT = "_corrupt"
SPLIT = "split"


def source_format(path: str) -> str:
    """Format by file ending; unknown endings are refused."""
    for ending, name in FORMATS.items():
        if path.lower().rstrip("/*").endswith(ending):
            return name
    raise ValueError(f"unsupported file format: {path}")


def validate_columns(found: Iterable[str], expected: Sequence[str] = HEADERS) -> None:
    """The header must hold every expected name once and no other; only the schema is looked at, no job runs."""
    times = Counter(found)
    breaches = {
        "missing": set(expected) - times.keys(),
        "unexpected": times.keys() - set(expected),
        "repeated": {name for name, n in times.items() if n > 1},
    }
    listed = "; ".join(f"{kind}: {', '.join(sorted(names))}" for kind, names in breaches.items() if names)
    if listed:
        raise ValueError(f"the header breaks the contract ({listed})")


def text_schema(columns: Sequence[str], corrupt: bool = False) -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in columns]
    return T.StructType(fields + ([T.StructField(CORRUPT, T.StringType())] if corrupt else []))


def csv_options(fmt: str, multiline: bool = False) -> dict[str, object]:
    """Reader options shared by the batch and the streaming form.

    Without ``multiline`` a file splits into many tasks, and a record with a line break inside quotes is rejected
    for its unbalanced quotes. With it such records are read, and one task reads a whole file.
    """
    return {
        "header": True,
        "sep": SEPARATORS[fmt],
        "quote": '"',
        "escape": '"',
        "multiLine": multiline,
        "encoding": "UTF-8",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "columnPruning": False,  # a pruned read does not notice wrong field counts
    }


def csv_header(spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = False) -> list[str]:
    """Column names of the first file, in file order."""
    fmt = fmt or source_format(path)
    return spark.read.options(**csv_options(fmt, multiline)).csv(path).columns


def read_source(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    *,
    expected: Sequence[str] | None = HEADERS,
    multiline: bool | str = False,
    keep_corrupt: bool = False,
    drop_rejects: bool = False,
) -> DataFrame:
    """A lazy text frame with the source's own headers.

    ``expected`` is the contract to hold the header to (``None`` skips it). The first file's
    header order is the schema, and every further file is checked against it while it is read.
    Empty fields of delimited files are null, and short rows are padded with nulls. A rejected record (too many
    fields, unbalanced quotes, broken JSON) stops the read with its text; ``drop_rejects`` leaves it out instead, and
    ``keep_corrupt`` keeps everything with the text in ``_corrupt`` for :func:`split_rejects`. JSON lines may leave
    out columns, but a key outside ``expected`` stops the read.

    ``multiline`` reads line breaks inside quotes: ``True`` by Spark's own reader, one task a file; ``"split"`` by many
    tasks a file, for one shuffle of the lines.
    """
    fmt = fmt or source_format(path)
    try:
        if fmt == "json":
            rows = json_records(spark.read.text(path), expected or HEADERS)
            return rows if keep_corrupt else _good_rows(rows, fmt, drop_rejects)
        columns = csv_header(spark, path, fmt, bool(multiline))
        if expected is not None:
            validate_columns(columns, expected)
        if multiline == SPLIT:
            rows = split_lines.parsed(spark, path, columns, csv_options(fmt), CORRUPT)
            return rows if keep_corrupt else _good_rows(rows, fmt, drop_rejects)
        reader = spark.read.options(**csv_options(fmt, multiline)).option("enforceSchema", False)
        rows = reader.schema(text_schema(columns, corrupt=True)).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    return rows if keep_corrupt else _good_rows(rows, fmt, drop_rejects)


def json_records(lines: DataFrame, expected: Sequence[str] = HEADERS) -> DataFrame:
    """Records of a text frame (``value``), batch or stream, as text columns with ``_corrupt``.

    An explicit text schema keeps leading zeros and reads numbers as written. It would also lose unknown keys, so
    each record's own keys are held to the contract first.
    """
    unknown = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, expected)))
    refused = F.raise_error(F.concat(F.lit("the record breaks the contract (unexpected: "), F.array_join(unknown, ", "), F.lit(")")))
    checked = F.when(F.size(unknown) > 0, refused.cast("string")).otherwise(F.col("value"))
    parsed = F.from_json(checked, text_schema(expected, corrupt=True), {"columnNameOfCorruptRecord": CORRUPT})
    return lines.where(F.trim("value") != "").select(parsed_once(parsed).alias("r")).select("r.*")


def parsed_once(parsed: Column) -> Column:
    """The same value by a generator: Spark copies a column's expression into every later filter and column that uses
    it, and would parse each record several times; what a generator yields is computed once."""
    return F.explode(F.array(parsed))


def field_count(record: Column, separator: str) -> Column:
    """Fields in a delimited record: separators outside quotes plus one.

    A doubled quote is the end of one quoted run and the start of the next, so it needs no pattern of its own.
    """
    unquoted = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(separator), F.lit(""))) + 1


def _marked(rows: DataFrame, bad: Column) -> Column:
    """``bad`` where there is a corrupt text.

    Spark refuses queries that touch the corrupt text alone, so the other branch names a data
    column, in a test that no text passes.
    """
    never = F.coalesce(F.length(rows.columns[0]) < 0, F.lit(False))
    return F.when(F.col(CORRUPT).isNotNull(), bad).otherwise(never)


def reject_reason(fmt: str, width: int) -> Column:
    """Why a corrupt text cannot be used; null for a short row, which is padded."""
    record = F.col(CORRUPT)
    if fmt == "json":
        return F.lit("not a JSON record")
    quotes = F.length(record) - F.length(F.replace(record, F.lit('"'), F.lit("")))
    return F.when(quotes % 2 == 1, "unbalanced quotes").when(field_count(record, SEPARATORS[fmt]) > width, "too many fields")


def split_rejects(rows: DataFrame, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected records with their reason). Short rows are good: their missing tail is null."""
    reason = reject_reason(fmt, len(rows.columns) - 1)
    rejected = _marked(rows, reason.isNotNull())
    return rows.where(~rejected).drop(CORRUPT), rows.where(rejected).select(F.col(CORRUPT).alias("record"), reason.alias("reason"))


def _good_rows(rows: DataFrame, fmt: str, drop_rejects: bool) -> DataFrame:
    if drop_rejects:
        return split_rejects(rows, fmt)[0]
    reason = reject_reason(fmt, len(rows.columns) - 1)
    text = F.concat(F.lit("rejected record ("), reason, F.lit("): "), F.substring(CORRUPT, 1, 200))
    stop = F.when(_marked(rows, reason.isNotNull()), F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return rows.where(stop).drop(CORRUPT)


def record_counts(rows: DataFrame, fmt: str = "csv") -> list[Column]:
    """Aggregates over a marked frame: ``records``, ``padded``, ``rejected``."""
    rejected = F.col(CORRUPT).isNotNull() & reject_reason(fmt, len(rows.columns) - 1).isNotNull()
    padded = F.col(CORRUPT).isNotNull() & ~rejected
    # Spark refuses to read the corrupt text alone, so the records are counted on a data column.
    first = F.col(rows.columns[0])
    return [
        (F.count(first) + F.count(F.when(first.isNull(), 1))).alias("records"),
        F.count(F.when(padded, 1)).alias("padded"),
        F.count(F.when(rejected, 1)).alias("rejected"),
    ]


def bad_record_counts(rows: DataFrame, fmt: str = "csv") -> DataFrame:
    """One row: records read, short ones (padded) and rejected ones."""
    return rows.agg(*record_counts(rows, fmt))


MOST_REJECTS = 100


def quarantine_rejects(rows: DataFrame, fmt: str, folder: str | None, most: int = MOST_REJECTS) -> tuple[int, int]:
    """(records read, records rejected). Rejected records are written to ``folder`` before more than ``most`` of
    them stop the load. Every path uses this: batch, dry run (without a folder) and stream."""
    counts = bad_record_counts(rows, fmt).first()
    if counts["rejected"] and folder:
        split_rejects(rows, fmt)[1].write.mode("overwrite").parquet(folder)
    refuse_rejects(counts["rejected"], most, folder)
    return counts["records"], counts["rejected"]


def refuse_rejects(rejected: int, most: int, folder: str | None = None) -> None:
    if rejected > most:
        kept = f", kept in {folder}" if folder else ""
        raise ValueError(f"{rejected} bad records, at most {most} are tolerated{kept}")


def project_canonical(df: DataFrame) -> DataFrame:
    """Headers to column names, in table order; an incomplete frame is refused."""
    renamed = df.withColumnsRenamed(HEADER_TO_NAME)
    missing = [n for n in NAMES if n not in renamed.columns]
    if missing:
        raise ValueError(f"columns missing for the table: {missing}")
    return renamed.select(*NAMES)


def fill_absent_columns(df: DataFrame, schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """Frame with every column of ``schema`` (absent ones null) and the list of absent names."""
    schema = schema or CLEAN_SCHEMA
    renamed = df.withColumnsRenamed(HEADER_TO_NAME)
    absent = [f.name for f in schema if f.name not in renamed.columns]
    columns = [
        F.lit(None).cast(f.dataType).alias(f.name) if f.name in absent else F.col(f.name) for f in schema
    ]
    return renamed.select(*columns), absent
