"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import new_folder, shared_root


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: its lineage is cut and its size is known.

    The folder is removed when the process ends. Rows come back in any order.
    """
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_partitions(df: DataFrame) -> DataFrame:
    """The same by ``checkpoint``, which keeps partitions and their order, but not the size; for narrow tables."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def small_side(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows`` (kept before, narrow) marked for broadcast if counted to be ``most`` at most; more are joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_apart(df: DataFrame, reserved: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns that have a reserved name under free ones, and the map from these back to their own."""
    back = {}
    for name in [c for c in df.columns if c.lower() in {r.lower() for r in reserved}]:
        free = free_name(df, f"own_{name}")
        df, back[free] = df.withColumnRenamed(name, free), name
    return df, back


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is.

    ``lower`` does the same on ASCII and is faster; elsewhere it would change letters beyond A-Z.
    """
    only_ascii = F.octet_length(text) == F.char_length(text)
    letters = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(only_ascii, F.lower(text)).otherwise(letters)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def values(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few literal rows of text, whole numbers and booleans as a JVM-side table."""

    def literal(x: object) -> str:
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(x).lower()

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
