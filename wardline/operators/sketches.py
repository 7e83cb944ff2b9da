"""Profiles from mergeable sketches: distinct values stored per load, and most frequent values without a full count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.profile import TOP_VALUE_COLUMNS, top_values, value_counts
from wardline.sources import store

# Registers of a sketch as a power of two; an estimate's standard error is 1.04 / sqrt(registers), here 0.8 %.
REGISTERS = 14
ERRORS = 4  # standard errors that an estimate may be off
SKETCHES = "load string, column_name string, rows long, present long, sketch binary"


def column_sketches(df: DataFrame, columns: Sequence[str], registers: int = REGISTERS) -> DataFrame:
    """``column_name, rows, present, sketch``: one aggregate of one scan, and no row for each cell."""
    wide = df.agg(
        F.count("*").alias("rows"),
        *(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("present"), F.hll_sketch_agg(F.col(c).cast("string"), registers).alias("sketch")).alias(c) for c in columns),
    )
    return wide.select("rows", F.explode(F.array(*columns)).alias("s")).select("s.column_name", "rows", "s.present", "s.sketch")


def store_sketches(df: DataFrame, path: str, load: str, columns: Sequence[str], registers: int = REGISTERS) -> None:
    """Write the sketches of one load; writing it again replaces them."""
    column_sketches(df, columns, registers).coalesce(1).write.mode("overwrite").parquet(f"{path}/load={load}")


def merged_profile(spark: SparkSession, path: str) -> DataFrame:
    """``column_name, rows, missing, distinct_estimate`` over all stored loads; no row of a table is read."""
    stored = store.read_fact(spark, path, spark.createDataFrame([], SKETCHES).schema)
    merged = stored.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("column_name", "rows", (F.col("rows") - F.col("present")).alias("missing"), F.hll_sketch_estimate("sketch").alias("distinct_estimate"))


def held_to_exact(estimated: DataFrame, df: DataFrame, columns: Sequence[str], registers: int = REGISTERS) -> DataFrame:
    """``estimated`` beside the exact count of distinct values, and whether it keeps its bound."""
    exact = value_counts(df, columns).groupBy("column_name").agg(F.count("value").alias("distinct_values"))
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_values"))
    bound = F.col("distinct_values") * F.lit(ERRORS * 1.04 / 2 ** (registers / 2))
    return estimated.join(exact, "column_name").select("column_name", "rows", "missing", "distinct_values", (off <= bound).alias("within_bound"))


# ---- frequent values ----------------------------------------------------------------------------

TRACKED = 4096  # values a task's summary follows in each column
CANDIDATES = 64


def heavy_hitters(df: DataFrame, columns: Sequence[str] = TOP_VALUE_COLUMNS, most: int = 10, candidates: int = CANDIDATES, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``top_values``, without shuffling the values that occur a few times only.

    Every task keeps a frequent-items summary (Misra-Gries counters) of each column; they merge to a list of candidates
    with a bound for the count of any value that is not on it. One more scan counts the candidates exactly. If the last
    of the ``most`` wanted counts is not above the bound, or the list may be cut within a tie, that column is counted
    in full instead. What is collected is at most ``candidates`` values for each column.
    """
    columns = list(columns)
    texts = df.select(*(F.col(c).cast("string").alias(c) for c in columns))
    summary = texts.agg(*(F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)), *(F.expr(f"approx_top_k(`{c}`, {candidates}, {tracked})").alias(f"t_{i}") for i, c in enumerate(columns)))
    row = summary.first()
    lists, bounds = {}, {}
    for i, c in enumerate(columns):
        met = [x for x in row[f"t_{i}"] or [] if x["item"] is not None]
        lists[c] = [x["item"] for x in met]
        # an unlisted value was cut from the list, or its count lies within the summary's error (3.5 / counters of the rows)
        cut = met[-1]["count"] if len(row[f"t_{i}"] or []) >= candidates else 0
        bounds[c] = max(cut, 2 * 3.5 * row[f"n_{i}"] / tracked) if _is_lossy(row[f"t_{i}"], candidates, row[f"n_{i}"], met) else 0
    counted = _count_listed(texts, {c: v for c, v in lists.items() if v}).collect()
    counts: dict[str, list[tuple[int, str]]] = {c: [] for c in columns}
    for r in counted:
        counts[r["column_name"]].append((-r["count"], r["value"]))
    sure, open_columns = [], []
    for c in columns:
        best = sorted(counts[c])[:most]
        enough = len(best) == most and -best[-1][0] > bounds[c]
        if enough or bounds[c] == 0:
            sure += [(c, value, -n, rank) for rank, (n, value) in enumerate(best, 1)]
        else:
            open_columns.append(c)
    out = df.sparkSession.createDataFrame(sure, "column_name string, value string, count long, rank int")
    return out.unionByName(top_values(df, open_columns, most)) if open_columns else out


def _is_lossy(found: list | None, candidates: int, rows: int, met: list) -> bool:
    """Whether values may be missing from the list: not if it is short and its counts make up all rows."""
    return len(found or []) >= candidates or sum(x["count"] for x in met) != rows


def _count_listed(texts: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """``column_name, value, count`` of the listed values; all others stay where they are."""
    listed = [F.when(F.col(c).isin(v), F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))) for c, v in lists.items()]
    if not listed:
        return texts.sparkSession.createDataFrame([], "column_name string, value string, count long")
    cells = texts.select(F.explode(F.array_compact(F.array(*listed))).alias("x")).select("x.*")
    return cells.groupBy("column_name", "value").agg(F.count("*").alias("count"))


