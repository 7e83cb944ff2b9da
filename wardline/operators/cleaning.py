"""Row cleaning under two profiles, strict (default) and relaxed.

Strict: trim, blank to null, unparsable or negative numbers to null, duplicates judged after
cleaning. Relaxed: duplicates judged on the raw text, first digit run as the stay, negative
amounts to zero, missing text to an empty string.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as X
from wardline.functions.identity import row_hash
from wardline.operators.dedup import drop_duplicates, fold_copies, group_copies
from wardline.schema import MONEY_COLUMNS, NAMES, REQUIRED

NEWBORN = "Newborn"


# ---- strict profile -------------------------------------------------------------------------


def strict_rows(raw: DataFrame) -> DataFrame:
    """Cleaned rows, duplicates still in.

    Numbers are parsed in one projection and range-checked in the next: each text is parsed once.
    """
    parsed = {
        "length_of_stay": X.to_int(F.replace(F.col("length_of_stay"), F.lit(" +"), F.lit(""))),
        "discharge_year": X.to_int(F.col("discharge_year"), "smallint"),
        "apr_severity_of_illness_code": X.to_int(F.col("apr_severity_of_illness_code"), "smallint"),
        "birth_weight": F.when(F.col("type_of_admission") == NEWBORN, X.blank_to_null(F.col("birth_weight"))),
        "total_charges": X.to_decimal(F.col("total_charges")),
        "total_costs": X.to_decimal(F.col("total_costs")),
    }
    rows = raw.select(*[parsed.get(n, X.blank_to_null(F.col(n))).alias(n) for n in NAMES])
    checked = {c: X.not_negative(F.col(c)) for c in ("length_of_stay", *MONEY_COLUMNS)}
    severity = F.col("apr_severity_of_illness_code")
    return rows.withColumns({**checked, "apr_severity_of_illness_code": F.when(severity.between(0, 255), severity)})


def strict_table(raw: DataFrame, in_place: bool = False) -> DataFrame:
    """Cleaned distinct rows with ``source_rows`` (copies each stands for) and ``row_hash``.

    Counting copies instead of a plain ``distinct`` costs one long per row and keeps the read and
    dropped counters in the table itself. The partial aggregate folds copies before the shuffle, so a heavily repeated
    row does not load one task. ``in_place`` is for large tables of few copies: it reads ``raw`` three times, and only
    rows that may have copies are shuffled as a whole.
    """
    fold = fold_copies if in_place else group_copies
    return fold(strict_rows(raw), NAMES).withColumn("row_hash", row_hash(NAMES))


# ---- relaxed profile ------------------------------------------------------------------------


def missing_tokens(df: DataFrame) -> DataFrame:
    """Texts that mean "missing" become null in every column."""
    tokens = ", ".join("'" + t.replace("'", "\\'") + "'" for t in X.MISSING_TOKENS)
    # As text: the literals of 33 columns one by one take the driver longer than a small batch's rows take its tasks.
    names = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return df.selectExpr(*[f"CASE WHEN NOT {n} IN ({tokens}) THEN {n} END AS {n}" for n in names])


def clean_money(df: DataFrame, columns: Sequence[str] = MONEY_COLUMNS) -> DataFrame:
    """Amount text without ``,``, ``$`` and white space as double; unparsable is null."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: X.to_double(F.col(c).cast("string")) for c in present})


def money_floor(df: DataFrame, columns: Sequence[str] = MONEY_COLUMNS) -> DataFrame:
    return df.withColumns({c: X.at_least_zero(F.col(c)) for c in columns if c in df.columns})


def normalize_types(df: DataFrame) -> DataFrame:
    """Stay, year and severity as integers, amounts not below zero."""
    codes = [c for c in ("discharge_year", "apr_severity_of_illness_code") if c in df.columns]
    parsed = {c: X.to_double(F.col(c).cast("string")) for c in codes}
    if "length_of_stay" in df.columns:
        parsed["length_of_stay"] = X.first_digits(F.col("length_of_stay").cast("string"))
    df = df.withColumns(parsed) if parsed else df
    typed = {c: X.whole(F.col(c), "smallint") for c in codes}
    return money_floor(df.withColumns(typed) if typed else df)


def handle_missing(df: DataFrame, fill: Mapping[str, object] | None = None) -> DataFrame:
    """Given fills per column; other text columns get an empty string, numbers stay null."""
    fill = dict(fill or {})
    rest = [n for n, t in df.dtypes if t == "string" and n not in fill]
    df = df.fillna("", subset=rest) if rest else df
    return df.fillna(fill) if fill else df


def clean_birth_weight(df: DataFrame) -> DataFrame:
    """Birth weight only for admissions of type Newborn."""
    if not {"birth_weight", "type_of_admission"} <= set(df.columns):
        return df
    kept = F.when(F.col("type_of_admission") == NEWBORN, F.col("birth_weight"))
    return df.withColumn("birth_weight", kept)


def relaxed_rows(distinct_raw: DataFrame, fill: Mapping[str, object] | None = None) -> DataFrame:
    """The row-level steps in their fixed order; the null birth weight must survive the fill."""
    return (
        distinct_raw.transform(clean_money)
        .transform(normalize_types)
        .transform(handle_missing, fill)
        .transform(clean_birth_weight)
    )


def relaxed_table(raw: DataFrame, fill: Mapping[str, object] | None = None) -> DataFrame:
    """Distinct raw rows without those that lack every required field, cleaned, with ``source_rows``."""
    return _valid(group_copies(missing_tokens(raw), raw.columns), fill)


def relaxed_copies(raw: DataFrame, fill: Mapping[str, object] | None = None) -> DataFrame:
    """The rows of ``relaxed_table``, each copy by itself (``source_rows`` 1), for those who fold them later."""
    return _valid(missing_tokens(raw).withColumn("source_rows", F.lit(1).cast("long")), fill)


def _valid(counted: DataFrame, fill: Mapping[str, object] | None) -> DataFrame:
    marked = mark_invalid(counted)
    return relaxed_rows(marked.where(~F.col("invalid")).drop("invalid"), fill)


def clean_relaxed(raw: DataFrame, fill: Mapping[str, object] | None = None, in_place: bool = False) -> DataFrame:
    """The plain pipeline: distinct raw rows, cleaned. ``in_place``: see :func:`strict_table`."""
    return relaxed_rows(drop_duplicates(missing_tokens(raw), in_place=in_place), fill)


def mark_invalid(raw: DataFrame) -> DataFrame:
    """Add ``invalid``: every required field is null once parsed. Judged before the text fill."""
    year = "_year"
    parsed = {
        "length_of_stay": X.first_digits(F.col("length_of_stay")),
        "discharge_year": X.whole(F.col(year), "smallint"),
        **{c: X.to_double(F.col(c)) for c in MONEY_COLUMNS},
    }
    present = [parsed.get(c, F.col(c)) for c in REQUIRED]
    rows = raw.withColumn(year, X.to_double(F.col("discharge_year")))
    return rows.withColumn("invalid", F.coalesce(*[c.cast("string") for c in present]).isNull()).drop(year)


def clean_stats(raw: DataFrame) -> DataFrame:
    """One row: ``rows_read, rows_after_clean, duplicates_removed, invalid_rows_removed``."""
    rows = mark_invalid(fold_copies(missing_tokens(raw), raw.columns))
    return rows.agg(
        F.coalesce(F.sum("source_rows"), F.lit(0)).alias("rows_read"),
        F.count(F.when(~F.col("invalid"), 1)).alias("rows_after_clean"),
        F.coalesce(F.sum(F.col("source_rows") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count(F.when(F.col("invalid"), 1)).alias("invalid_rows_removed"),
    )
