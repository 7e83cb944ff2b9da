"""Several group-bys from one scan: the long profile, the overview and the dashboard tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.money import cents, high, joined, low
from wardline.operators.aggregate import DIMENSIONS, aggregate, apply_filters, share_of, summary

UNLABELLED = "未标注"
# Overview section, its dimension, its number of rows.
SECTIONS: list[tuple[str, str, int]] = [
    ("trend", "year", 50),
    ("diseases", "disease", 8),
    ("ages", "age_group", 10),
    ("payments", "payment", 20),
    ("genders", "gender", 10),
    ("severity", "severity", 10),
]
# Metrics shown per overview section.
SECTION_METRICS = {
    "trend": ["avg_total_charges", "avg_length_of_stay"],
    "diseases": ["avg_length_of_stay", "avg_total_charges"],
    "ages": ["avg_length_of_stay"],
    "payments": ["ratio"],
    "genders": [],
    "severity": ["avg_length_of_stay"],
}
GENDER_LABELS = {"F": "女性", "M": "男性"}
UNKNOWN_GENDER = "未知"
HIGH_SEVERITY = r"(?i)major|extreme|重度|极重度"

_AMOUNTS = {"charges": "total_charges", "costs": "total_costs"}


def _measures() -> dict[str, Column]:
    """What is summed per group: the stay, and each amount in its two parts."""
    out = {"stay": F.col("length_of_stay")}
    for short, column in _AMOUNTS.items():
        out[f"{short}_high"], out[f"{short}_low"] = high(cents(column)), low(cents(column))
    return out


def long_profile(df: DataFrame, dimensions: Sequence[str], by_year: bool = False) -> DataFrame:
    """``dimension, dimension_value`` (and year) with counts and additive sums, in one scan.

    The rows are unfolded once per dimension and folded again by the partial aggregate before the
    shuffle, so what is shuffled grows with the number of groups, not of rows.
    """
    measures, year = _measures(), ["in_year"] if by_year else []
    ids = [c.alias(n) for n, c in measures.items()] + [F.col("discharge_year").alias(y) for y in year]
    values = [F.col(DIMENSIONS[d]).cast("string").alias(f"_{d}") for d in dimensions]
    wide = df.select(*ids, *values)
    long = wide.unpivot([*measures, *year], [f"_{d}" for d in dimensions], "dimension", "dimension_value")
    sums = long.groupBy("dimension", "dimension_value", *year).agg(
        F.count("*").alias("count"),
        *[F.sum(m).alias(f"sum_{m}") for m in measures],
        F.count("stay").alias("n_stay"),
        *[F.count(f"{a}_high").alias(f"n_{a}") for a in _AMOUNTS],
    )
    return sums.withColumn("dimension", F.substring("dimension", 2, 64))


def with_all_years(profile: DataFrame) -> DataFrame:
    """Add, to groups by year, the same groups over all years (``whole``), from the small result."""
    names = [c for c in profile.columns if c == "count" or c.startswith(("sum_", "n_"))]
    keys = ["dimension", "dimension_value"]
    sets = [[*keys, "in_year"], keys]
    columns = [[F.col(c) for c in group] for group in sets]
    merged = profile.groupingSets(columns, *keys, "in_year").agg(
        *[F.sum(c).alias(c) for c in names], (F.grouping("in_year") == 1).alias("whole")
    )
    return merged.where(F.col("whole") | F.col("in_year").isNotNull())


def profile_metrics() -> dict[str, Column]:
    """The six metrics out of the additive sums."""

    def amount(short: str) -> Column:
        return joined(F.col(f"sum_{short}_high"), F.col(f"sum_{short}_low"))

    def mean(total: Column, short: str) -> Column:
        return F.try_divide(total, F.col(f"n_{short}").cast("double"))

    return {
        "count": F.col("count"),
        "avg_length_of_stay": mean(F.col("sum_stay").cast("double"), "stay"),
        "avg_total_charges": mean(amount("charges"), "charges"),
        "sum_total_charges": amount("charges"),
        "avg_total_costs": mean(amount("costs"), "costs"),
        "sum_total_costs": amount("costs"),
    }


def ranked(profile: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Rank per section: years in order, other groups by count then value; at most ``most`` rows.

    The constant bound lets Spark cut each section on the map side before the window's shuffle.
    """
    year = F.when(F.col("dimension") == "year", F.col("dimension_value").try_cast("int"))
    count = F.when(F.col("dimension") != "year", F.col("count"))
    window = Window.partitionBy(*keys).orderBy(
        year.asc_nulls_first(), count.desc_nulls_last(), F.col("dimension_value").asc_nulls_first()
    )
    return profile.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def overview(df: DataFrame, filters: Mapping | None = None) -> DataFrame:
    """All overview sections in one long table: ``section, rank, dimension_value``, metrics.

    The summary row has rank 0; metrics a section does not show are null. One scan serves all
    sections, one of three columns the summary, and one of no column the share's total.
    """
    rows = apply_filters(df, filters)
    none, metrics = F.lit(None), profile_metrics()
    head = summary(rows).select(
        F.lit("summary").alias("section"), F.lit(0).alias("rank"), none.cast("string").alias("dimension_value"),
        F.col("discharges").alias("count"), "avg_length_of_stay", "avg_total_charges",
        none.cast("double").alias("ratio"), "facilities", "total_charges",
    )
    profile = long_profile(rows, [d for _, d, _ in SECTIONS])
    return head.unionByName(_sections(profile, share_of(rows)))


def _sections(profile: DataFrame, share: Column) -> DataFrame:
    """The ranked sections out of the additive sums of their dimensions; ``share`` is the share of all rows."""
    none, metrics = F.lit(None), profile_metrics()
    section, limit = none.cast("string"), F.lit(0)
    for name, dimension, most in SECTIONS:
        here = F.col("dimension") == dimension
        section, limit = F.when(here, name).otherwise(section), F.when(here, most).otherwise(limit)

    def shown(metric: str, value: Column) -> Column:
        sections = [s for s, m in SECTION_METRICS.items() if metric in m]
        return F.when(F.col("section").isin(*sections), value).alias(metric)

    return (
        ranked(profile, ["dimension"], max(most for _, _, most in SECTIONS))
        .withColumn("section", section)
        .where(F.col("rank") <= limit)
        .select(
            "section", "rank", "dimension_value", "count",
            shown("avg_length_of_stay", metrics["avg_length_of_stay"]),
            shown("avg_total_charges", metrics["avg_total_charges"]),
            shown("ratio", share),
            none.cast("bigint").alias("facilities"), none.cast("double").alias("total_charges"),
        )
    )


def overview_of(profile: DataFrame) -> DataFrame:
    """The overview out of the additive sums of its dimensions and of ``hospital``.

    A facility is a non-empty value of the dimension hospital, and every row has one year, or none.
    """
    none, metrics = F.lit(None), profile_metrics()
    sums = [c for c in profile.columns if c == "count" or c.startswith(("sum_", "n_"))]
    named = (F.col("dimension") == "hospital") & F.col("dimension_value").isNotNull() & (F.col("dimension_value") != "")
    of_year = lambda c: F.sum(F.when(F.col("dimension") == "year", F.col(c))).alias(c)
    totals = profile.where(F.col("dimension").isin("hospital", "year")).agg(F.count(F.when(named, 1)).alias("facilities"), *(of_year(c) for c in sums))
    head = totals.select(
        F.lit("summary").alias("section"), F.lit(0).alias("rank"), none.cast("string").alias("dimension_value"),
        F.coalesce("count", F.lit(0)).alias("count"), metrics["avg_length_of_stay"].alias("avg_length_of_stay"),
        metrics["avg_total_charges"].alias("avg_total_charges"), none.cast("double").alias("ratio"), "facilities",
        metrics["sum_total_charges"].alias("total_charges"),
    )
    share = F.round(F.col("count").cast("double") / totals.select(F.col("count").cast("double")).scalar(), 6)
    return head.unionByName(_sections(profile.where(F.col("dimension").isin([d for _, d, _ in SECTIONS])), share))


# ---- tables the dashboard derives from group-by results ---------------------------------------


def share_of_shown(rows: DataFrame) -> DataFrame:
    """Percent of the shown rows' sum. ``rows`` is a limited result (100 rows at most)."""
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    percent = F.coalesce(F.try_divide(100 * F.col("count").cast("double"), total.cast("double")), F.lit(0.0))
    return rows.withColumn("percent", percent)


def top_group(rows: DataFrame) -> DataFrame:
    """The value with the highest count, the smallest value on a tie."""
    best = F.min_by(F.struct("dimension_value", "count"), F.struct(-F.col("count"), "dimension_value"))
    return rows.agg(best.alias("b")).select("b.*")


def segments(df: DataFrame) -> DataFrame:
    """Three patient segments: top age group, top disease, high severity.

    Each reads one column, so three scans read no more than a joint one.
    """
    ages = aggregate(df, "age_group", ["count"], 10)
    diseases = aggregate(df, "disease", ["count"], 8)
    severity = df.groupBy(F.col(DIMENSIONS["severity"]).alias("dimension_value")).agg(F.count("*").alias("count"))

    def top(rows: DataFrame, segment: str) -> DataFrame:
        first = F.struct(-F.col("count"), "dimension_value")
        return rows.agg(
            F.lit(segment).alias("segment"),
            F.min_by("dimension_value", first).alias("detail"),
            F.max("count").alias("count"),
            (100 * F.try_divide(F.max("count").cast("double"), F.sum("count").cast("double"))).alias("percent"),
        )

    high = F.sum(F.when(F.col("dimension_value").rlike(HIGH_SEVERITY), F.col("count")).otherwise(0))
    risk = severity.agg(
        F.lit("high_severity").alias("segment"),
        F.lit("APR Major / Extreme").alias("detail"),
        F.coalesce(high, F.lit(0)).alias("count"),
        F.coalesce(100 * F.try_divide(high.cast("double"), F.sum("count").cast("double")), F.lit(0.0)).alias("percent"),
    )
    return top(ages, "top_age").unionByName(top(diseases, "top_disease")).unionByName(risk)


def label(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNLABELLED))


def disease_table(rows: DataFrame) -> DataFrame:
    """Display form of the top diseases: stay to 1 digit, charges to whole units."""
    return rows.select(
        label(F.col("dimension_value")).alias("name"),
        "count",
        F.round("avg_length_of_stay", 1).alias("days"),
        F.round("avg_total_charges", 0).alias("charges"),
    )


def gender_share(rows: DataFrame) -> DataFrame:
    shown = share_of_shown(rows)
    name = F.lit(UNKNOWN_GENDER)
    for code, text in GENDER_LABELS.items():
        name = F.when(F.col("dimension_value") == code, text).otherwise(name)
    return shown.select(name.alias("label"), F.round("percent", 1).alias("percent"))


def payment_percent(rows: DataFrame) -> DataFrame:
    return rows.select(label(F.col("payment")).alias("name"), F.round(100 * F.col("ratio"), 2).alias("percent"))


def trend_series(rows: DataFrame) -> DataFrame:
    return rows.select("year", "count", F.round("avg_length_of_stay", 2).alias("avg_length_of_stay"))


def kpis(summary: DataFrame) -> DataFrame:
    """Records, mean stay to 2 digits, mean charges to whole units, facilities."""
    return summary.select(
        F.col("discharges").alias("records"),
        F.round("avg_length_of_stay", 2).alias("avg_length_of_stay"),
        F.round("avg_total_charges", 0).alias("avg_total_charges"),
        "facilities",
    )
