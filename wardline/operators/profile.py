"""Column profiles, anomaly counters and facility and cross-source audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import text as X
from wardline.operators.cleaning import NEWBORN

# Columns with a top-10 list, fields of the missing-value snapshot.
TOP_VALUE_COLUMNS = [
    "age_group", "birth_weight", "ccsr_diagnosis_description", "discharge_year", "emergency_department_indicator",
    "gender", "length_of_stay", "payment_typology_1", "apr_severity_of_illness_desc", "total_charges", "total_costs",
]
SNAPSHOT_FIELDS = [
    "age_group", "facility_name", "ccsr_diagnosis_description", "apr_severity_of_illness_desc", "payment_typology_1",
    "length_of_stay", "total_charges", "total_costs",
]
# Major diagnostic category of newborns and neonates.
NEWBORN_MDC = ("15",)
HEAVIEST_BIRTH = 15000


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]


def _unfold(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per cell: ``column_name, value`` as text."""
    return df.select(*[F.col(c).cast("string") for c in columns]).unpivot([], list(columns), "column_name", "value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, value, count``; folded per task before the shuffle."""
    return _unfold(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("count"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: rows, missing, missing rate, distinct values, and count/min/mean/max/std of numbers.

    The exact form counts the value groups of every column. ``approximate`` takes sketches for the
    distinct values instead, in one aggregate without any large shuffle.
    """
    columns = list(columns or df.columns)
    numbers = _numeric(df, columns)
    if approximate:
        wide = df.agg(
            F.count("*").alias("rows"),
            *[F.struct(F.count(c).alias("n"), F.approx_count_distinct(c).alias("d")).alias(c) for c in columns],
        )
        cells = [F.struct(F.lit(c).alias("column_name"), "rows", f"{c}.n", f"{c}.d") for c in columns]
        base = wide.select(F.explode(F.array(*cells)).alias("p")).select(
            "p.column_name", "p.rows", (F.col("p.rows") - F.col("p.n")).alias("missing"), F.col("p.d").alias("distinct_values")
        )
    else:
        base = (
            value_counts(df, columns)
            .groupBy("column_name")
            .agg(
                F.sum("count").alias("rows"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing"),
                F.count("value").alias("distinct_values"),
            )
        )
    base = base.withColumn("missing_rate", X.ratio(F.col("missing"), F.col("rows")))
    stats = _number_stats(df, numbers) if numbers else None
    names = ["number_count", "min", "mean", "max", "std"]
    if stats is None:
        return base.withColumns({n: F.lit(None).cast("double") for n in names})
    return base.join(F.broadcast(stats), "column_name", "left")  # one row per numeric column


def _number_stats(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(c).alias("number_count"),
                F.min(c).cast("double").alias("min"),
                F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double")).alias("mean"),
                F.max(c).cast("double").alias("max"),
                F.stddev_samp(F.col(c).cast("double")).alias("std"),
            ).alias(c)
            for c in numbers
        ]
    )
    return wide.select(F.explode(F.array(*numbers)).alias("p")).select("p.*")


def top_values(df: DataFrame, columns: Sequence[str] = TOP_VALUE_COLUMNS, most: int = 10) -> DataFrame:
    """The most frequent values of each column, missing ones left out."""
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    window = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def field_missing(df: DataFrame, fields: Sequence[str] = SNAPSHOT_FIELDS) -> DataFrame:
    """``field, missing_count, missing_rate`` (percent, 4 digits)."""
    wide = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in fields])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), (F.col("rows") - F.col(c)).alias("n"), "rows") for c in fields])
    long = wide.select(F.explode(rows).alias("f")).select("f.*")
    rate = F.round(100 * X.ratio(F.col("n"), F.col("rows")), 4)
    return long.select("field", F.col("n").alias("missing_count"), rate.alias("missing_rate"))


def newborn_context(mdc_codes: Sequence[str] = NEWBORN_MDC, drg_codes: Sequence[str] = ()) -> Column:
    """Admission, MDC or DRG marks the record as a newborn's."""
    marked = F.coalesce(F.col("type_of_admission") == NEWBORN, F.lit(False))
    for column, codes in (("apr_mdc_code", mdc_codes), ("apr_drg_code", drg_codes)):
        if codes:
            marked = marked | F.coalesce(F.trim(F.col(column)).isin(*codes), F.lit(False))
    return marked


def context_weight(mdc_codes: Sequence[str] = NEWBORN_MDC, drg_codes: Sequence[str] = ()) -> Column:
    grams = X.to_int(F.col("birth_weight"))
    usable = newborn_context(mdc_codes, drg_codes) & grams.between(1, HEAVIEST_BIRTH)
    return F.when(usable, grams)


def birth_weight_context(
    raw: DataFrame, mdc_codes: Sequence[str] = NEWBORN_MDC, drg_codes: Sequence[str] = ()
) -> DataFrame:
    """Birth weight by newborn context; the text of the stay is kept next to its number."""
    return raw.withColumns(
        {
            "birth_weight": context_weight(mdc_codes, drg_codes),
            "length_of_stay_raw": F.col("length_of_stay"),
            "length_of_stay": X.first_digits(F.col("length_of_stay")),
        }
    )


def anomaly_rules(last_year: int, first_year: int = 1900) -> dict[str, Column]:
    """Rule name to violation, over raw text. A blank value is missing, not invalid."""

    def filled(c: str) -> Column:
        return F.trim(F.col(c)) != ""

    def not_whole(c: str, low: int, high: int) -> Column:
        return filled(c) & ~F.coalesce(X.to_int(F.col(c)).between(low, high), F.lit(False))

    def amount(c: str) -> Column:
        return X.to_decimal(F.col(c))

    stay = X.to_int(X.remove(F.col("length_of_stay"), " +", "+"))
    return {
        "birth_weight_cleared": filled("birth_weight") & context_weight().isNull(),
        "invalid_apr_drg_code": not_whole("apr_drg_code", 0, 999),
        "invalid_apr_mdc_code": not_whole("apr_mdc_code", 0, 25),
        "invalid_discharge_year": not_whole("discharge_year", first_year, last_year),
        "invalid_emergency_indicator": filled("emergency_department_indicator")
        & ~F.col("emergency_department_indicator").isin("Y", "N"),
        "invalid_facility_id": not_whole("permanent_facility_id", 1, 2**31 - 1),
        "invalid_length_of_stay": filled("length_of_stay") & ~F.coalesce(stay >= 0, F.lit(False)),
        "invalid_severity_code": not_whole("apr_severity_of_illness_code", 0, 4),
        "invalid_total_charges": filled("total_charges") & amount("total_charges").isNull(),
        "invalid_total_costs": filled("total_costs") & amount("total_costs").isNull(),
        "negative_total_charges": amount("total_charges") < 0,
        "negative_total_costs": amount("total_costs") < 0,
    }


def count_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rule, violations`` from one aggregate."""
    wide = df.agg(*[F.coalesce(F.sum(X.one(rule)), F.lit(0)).alias(name) for name, rule in rules.items()])
    return wide.unpivot([], list(rules), "rule", "violations")


def clean_rules(last_year: int) -> dict[str, Column]:
    """The six checks of the validity score, over the clean table."""
    weight = F.col("birth_weight").try_cast("int")
    return {
        "negative_charges": F.col("total_charges") < 0,
        "negative_costs": F.col("total_costs") < 0,
        "invalid_length_of_stay": F.col("length_of_stay").isNull() | (F.col("length_of_stay") < 0),
        "invalid_birth_weight": F.col("birth_weight").isNotNull()
        & ~F.coalesce(weight.between(1, HEAVIEST_BIRTH), F.lit(False)),
        "invalid_year": ~F.coalesce(F.col("discharge_year").between(1900, last_year), F.lit(False)),
        "invalid_emergency_indicator": ~F.coalesce(
            F.col("emergency_department_indicator").isin("Y", "N"), F.lit(False)
        ),
    }


def consistent_row(last_year: int) -> Column:
    """Year, emergency flag and stay are all within their rules."""
    rules = clean_rules(last_year)
    return ~(rules["invalid_year"] | rules["invalid_emergency_indicator"] | rules["invalid_length_of_stay"])


def facility_audit(sources: Mapping[str, DataFrame]) -> DataFrame:
    """``check_name, source, value``: ten counts per source.

    Each source is first folded to its (id, name) pairs; all distinct counts work on those.
    """
    parts = [_audit(name, df) for name, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _audit(source: str, df: DataFrame) -> DataFrame:
    name, fid = F.col("facility_name"), F.col("permanent_facility_id")
    pairs = df.groupBy("facility_name", "permanent_facility_id").agg(F.count("*").alias("n"))

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    filled = F.when(name != "", name)
    trimmed = F.nullif(F.trim(name), F.lit(""))
    checks = {
        "rows": F.coalesce(F.sum("n"), F.lit(0)),
        "distinct_name": F.countDistinct(filled),
        "null_name": rows(name.isNull()),
        "empty_name": rows(name == ""),
        "blank_name": rows((name != "") & (F.trim(name) == "")),
        "distinct_trimmed": F.countDistinct(trimmed),
        "distinct_case_folded": F.countDistinct(F.lower(filled)),
        "control_or_special_space": rows(name.rlike("[\\x00-\\x1f\\x7f\\u00a0\\ufeff]")),
        "distinct_id": F.countDistinct(fid),
        "distinct_id_or_name": F.countDistinct(F.coalesce(fid, name)),
    }
    wide = pairs.agg(*[c.alias(n) for n, c in checks.items()])
    return wide.unpivot([], list(checks), "check_name", "value").withColumn("source", F.lit(source))


def cross_source_check(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and facilities per copy of the data, and whether all copies agree."""
    parts = []
    for name, df in sources.items():
        present = F.col("facility_name").isNotNull() & (F.col("facility_name") != "")
        groups = df.groupBy("facility_name").agg(F.count("*").alias("n"))
        parts.append(
            groups.agg(
                F.lit(name).alias("source"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.count(F.when(present, 1)).alias("facilities"),
            )
        )
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    # One row per copy: the window spans as many rows as there are sources.
    everything = Window.partitionBy(F.lit(1))
    same = [F.min(c).over(everything) == F.max(c).over(everything) for c in ("rows", "facilities")]
    return counts.withColumn("passed", same[0] & same[1])
