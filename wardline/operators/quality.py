"""Data-quality scores.

Each score is a sum of per-row marks over a count, so partial sums from partitions or batches
add up exactly and the division comes last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as X
from wardline.functions.identity import row_hash
from wardline.schema import REQUIRED

# Accepted codes per field. An empty risk level is accepted, an empty flag is not.
VALID_CODES = {
    "gender": ["M", "F", "U"],
    "emergency_department_indicator": ["Y", "N"],
    "apr_risk_of_mortality": ["Minor", "Moderate", "Major", "Extreme", ""],
}
NUMBER_FIELDS = ["length_of_stay", "total_charges", "total_costs"]
FIRST_YEAR = 2000
SCORES = ["completeness", "accuracy", "consistency", "timeliness"]


SUM_COLUMNS = ["rows", "distinct_rows", *[f"{n}_{k}" for n in SCORES for k in ("marks", "possible")]]


def _sum(marks: Sequence[Column]) -> Column:
    total = F.lit(0).cast("bigint")
    for mark in marks:
        total = total + mark
    return total


def row_marks(columns: Sequence[str], last_year: int) -> dict[str, tuple[Column, int]]:
    """Score name to (marks a row earns, marks it could earn); absent columns do not count."""
    text = {c: F.col(c).cast("string") for c in columns}
    complete = [X.one(text[c] != "") for c in REQUIRED if c in text]
    accurate = [X.one(X.plain_double(text[c]) >= 0) for c in NUMBER_FIELDS if c in text]
    consistent = [
        X.one(F.coalesce(text[c], F.lit("")).isin(*codes)) for c, codes in VALID_CODES.items() if c in text
    ]
    timely = []
    if "discharge_year" in text:
        timely = [X.one(X.to_double(text["discharge_year"]).between(FIRST_YEAR, last_year))]
    marks = dict(zip(SCORES, (complete, accurate, consistent, timely)))
    return {name: (_sum(found), len(found)) for name, found in marks.items()}


def score(name: str, raw: DataFrame, last_year: int) -> DataFrame:
    """A single score over a frame, as one row and one column."""
    marks, possible = row_marks(raw.columns, last_year)[name]
    return raw.agg(X.ratio(F.sum(marks), F.count("*") * F.lit(possible)).alias(name))


def uniqueness(raw: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows over rows. Only the row hash is shuffled, not the row."""
    groups = raw.select(row_hash(subset or raw.columns).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return groups.agg(X.ratio(F.count("*"), F.sum("n")).alias("uniqueness"))


def quality_sums(raw: DataFrame, last_year: int, by: Sequence[str] = ()) -> DataFrame:
    """Mark sums, row count and distinct-row count per chunk or in total.

    ``by`` names chunk columns, which are not part of the record.

    The marks depend on the row's own values, so copies share them and one grouping by row hash
    serves both the marks and the uniqueness.
    """
    columns = [c for c in raw.columns if c not in by]
    marks = row_marks(columns, last_year)
    rows = raw.select(
        *by,
        row_hash(columns).alias("_hash"),
        *[m.cast("int").alias(f"_{n}") for n, (m, _) in marks.items()],
    )
    keys = [*by, "_hash", *[f"_{n}" for n in marks]]
    folded = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return folded.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_rows"),
        *[F.coalesce(F.sum(F.col(f"_{n}") * F.col("_n")), F.lit(0)).alias(f"{n}_marks") for n in marks],
        *[
            (F.coalesce(F.sum("_n"), F.lit(0)) * F.lit(possible)).alias(f"{n}_possible")
            for n, (_, possible) in marks.items()
        ],
    )


def merge_sums(sums: DataFrame) -> DataFrame:
    """Add the sums of several chunks; distinct rows are then counted per chunk."""
    return sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUM_COLUMNS])


def report(sums: DataFrame) -> DataFrame:
    """Scores rounded to 4 digits; ``overall`` is the mean of the first four rounded scores."""
    rounded = sums.select(
        *[F.round(X.ratio(F.col(f"{n}_marks"), F.col(f"{n}_possible")), 4).alias(n) for n in SCORES],
        F.round(X.ratio(F.col("distinct_rows"), F.col("rows")), 4).alias("uniqueness"),
        F.col("rows").alias("sample_size"),
    )
    return rounded.withColumn("overall", overall())


def overall() -> Column:
    completeness, accuracy, consistency, timeliness = (F.col(n) for n in SCORES)
    return F.round((completeness + accuracy + consistency + timeliness) / F.lit(4.0), 4)


def assess(raw: DataFrame, last_year: int) -> DataFrame:
    return report(quality_sums(raw, last_year))


def percentages(quality: DataFrame) -> DataFrame:
    """Dashboard form: the four scores and the pass rate (uniqueness) in percent, to 2 digits."""
    return quality.select(
        *[F.round(F.col(n) * 100, 2).alias(f"{n}_percent") for n in SCORES],
        F.round(F.col("uniqueness") * 100, 2).alias("pass_rate_percent"),
        F.round(F.col("overall") * 100, 2).alias("overall_percent"),
    )


def strict_conditions(last_year: int) -> dict[str, Column]:
    """Whole-row rules over the clean table."""
    return {
        "completeness": F.col("facility_name").isNotNull()
        & F.col("age_group").isNotNull()
        & F.col("discharge_year").isNotNull()
        & F.col("ccsr_diagnosis_description").isNotNull()
        & F.col("payment_typology_1").isNotNull(),
        "accuracy": (F.col("length_of_stay") >= 0) & (F.col("total_charges") >= 0) & (F.col("total_costs") >= 0),
        "consistency": F.col("gender").isin("M", "F", "U") & F.col("emergency_department_indicator").isin("Y", "N"),
        "timeliness": F.col("discharge_year").between(FIRST_YEAR, last_year),
    }


def strict_scores(fact: DataFrame, last_year: int) -> DataFrame:
    """The four scores over the clean table, unrounded."""
    return fact.agg(
        *[X.ratio(F.sum(X.one(c)), F.count("*")).alias(n) for n, c in strict_conditions(last_year).items()]
    )


def strict_aggregates(last_year: int) -> list[Column]:
    """Aggregates of the rounded scores; the read counter comes from the ``source_rows`` the load kept."""
    return [
        *[F.round(X.ratio(F.sum(X.one(c)), F.count("*")), 4).alias(n) for n, c in strict_conditions(last_year).items()],
        F.round(X.ratio(F.count("*"), F.sum("source_rows")), 4).alias("uniqueness"),
        F.coalesce(F.sum("source_rows"), F.lit(0)).alias("sample_size"),
    ]


def strict_report(fact: DataFrame, last_year: int) -> DataFrame:
    return fact.agg(*strict_aggregates(last_year)).withColumn("overall", overall())


def cell_scores(fact: DataFrame, columns: Sequence[str], rules: dict[str, Column], consistency: Column) -> DataFrame:
    """Cell completeness, rule validity, row consistency and duplicate rate, in percent."""
    rows, cells = F.count("*"), F.count("*") * F.lit(len(columns))
    read = F.coalesce(F.sum("source_rows"), F.lit(0))
    present = _sum([F.count(c) for c in columns])
    broken = _sum([F.sum(X.one(rule)) for rule in rules.values()])
    return fact.agg(
        rows.alias("total_rows"),
        F.round(100 * X.ratio(present, cells), 2).alias("completeness_percent"),
        F.round(100 * (1 - X.ratio(broken, rows * F.lit(len(rules)))), 2).alias("validity_percent"),
        F.round(100 * X.ratio(F.sum(X.one(consistency)), rows), 2).alias("consistency_percent"),
        F.round(100 * X.ratio(read - rows, read), 4).alias("duplicate_rate_percent"),
    )
