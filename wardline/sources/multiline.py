"""Delimited files whose quoted fields hold line breaks, read by many tasks.

A line of such a file starts a record if the quote marks before it in the file are even in number. Each split counts
its own marks; sums over the splits before it tell how it begins, and sums over its lines tell the rest. So lines are
dealt by split, not by file. A line that is a record by itself, which most are, goes straight on; only lines that lie
in quotes are brought together, also across the border of splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTE = '"'
SPLIT = ("file", "split")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, value): every line with its place; a line belongs to the split in which it starts."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _quotes(value: Column) -> Column:
    return (F.length(value) - F.length(F.replace(value, F.lit(QUOTE), F.lit("")))) % 2


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, value, owner, number, alone): the record of each line, named by the split and the number of
    its first line there; ``alone`` where the line is the whole record."""
    lines = _lines(spark, path).withColumn("odd", _quotes(F.col("value")))
    marks = lines.groupBy(*SPLIT).agg(F.sum("odd").alias("marks"))  # one row a split
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    opens = marks.select(*SPLIT, (F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2).alias("inside"))
    earlier = W.partitionBy(*SPLIT).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*SPLIT).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    dealt = lines.join(opens, list(SPLIT))
    inside = (F.col("inside") + F.coalesce(F.sum("odd").over(earlier), F.lit(0))) % 2
    dealt = dealt.withColumn("start", 1 - inside).withColumn("number", F.sum("start").over(upto))
    return dealt.withColumn("alone", (F.col("start") == 1) & (F.col("odd") == 0)).drop("odd", "inside")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, number, record) for every record of the files, line breaks as ``\\n``, the header lines included."""
    placed = placed_lines(spark, path)
    single = placed.where("alone").select(*SPLIT, "number", F.col("value").alias("record"))
    rest = placed.where(~F.col("alone"))
    # a line before the first start of its split goes on with the last record of an earlier split
    starts = placed.groupBy(*SPLIT).agg(F.max("number").alias("last"))
    began = F.when(F.col("last") > 0, F.struct("split", "last"))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    owners = starts.select(*SPLIT, F.last(began, ignorenulls=True).over(earlier).alias("owner"))
    owned = rest.join(owners, list(SPLIT))
    foreign = (F.col("number") == 0) & F.col("owner").isNotNull()
    owned = owned.select(
        "file", F.when(foreign, F.col("owner.split")).otherwise(F.col("split")).alias("split"),
        F.when(foreign, F.col("owner.last")).otherwise(F.col("number")).alias("number"), F.struct(F.col("split").alias("s"), "at", "value").alias("line"),
    )
    joined = owned.groupBy(*SPLIT, "number").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    whole = joined.select(*SPLIT, "number", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    return single.unionByName(whole)


def parsed(spark: SparkSession, path: str, columns: Sequence[str], options: dict, corrupt: str) -> DataFrame:
    """Text columns and the corrupt text, as a read of the files gives them. Every file's header must be ``columns``."""
    found = records(spark, path)
    text = F.regexp_replace(F.regexp_replace("record", "\r$", ""), "^﻿", "")
    schema = ", ".join(f"`{c}` string" for c in [*columns, corrupt])
    row = F.from_csv(text, schema, {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k not in ("header", "columnPruning", "multiLine")})
    first = (F.col("split") == 0) & (F.col("number") == 1)
    # by a generator, so that a record is parsed once however many columns and tests name its cells
    cells = found.where(F.trim("record") != "").select(first.alias("first"), F.explode(F.array(row)).alias("r"), "record")
    header = F.array(*(F.coalesce(F.col(f"r.`{c}`"), F.lit("")) for c in columns))
    wrong = F.col("first") & (header != F.array(*map(F.lit, columns)))
    stop = F.raise_error(F.concat(F.lit("the header of a file differs from the first one's: "), F.substring(text, 1, 200)))
    checked = cells.where(F.when(wrong, stop.cast("boolean")).otherwise(~F.col("first")))
    return checked.select(*(F.col(f"r.`{c}`").alias(c) for c in [*columns, corrupt]))
