"""Answers to tagged questions, summary sentences and reports, from long result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import plain_decimals
from wardline.operators import aggregate as A
from wardline.operators.overview import UNLABELLED, long_profile, profile_metrics, ranked, with_all_years
from wardline.operators.questions import DIMENSION_RULES, TOP_LIMIT
from wardline.session import new_folder

METRIC_NAMES = list(A.METRICS)
# Sentences of the summary, report title and default sections.
EMPTY_SENTENCE = "未查询到「%s」下的有效数据，请调整筛选条件后重试。"
LEAD_SENTENCE = "本次按%s统计，共得到 %s 个分组；数量最高的是「%s」，共 %s 条记录。"
RATIO_SENTENCE = "其占总体的 %s%%。"
STAY_SENTENCE = "该组平均住院日为 %s 天。"
CHARGE_SENTENCE = "次均费用约 %s 元。"
REPORT_TITLE = "医疗大数据洞察报告"
DEFAULT_SECTIONS = [
    ("疾病住院量与费用", "disease", 10),
    ("患者年龄结构", "age_group", 10),
    ("支付方式构成", "payment", 20),
]
MOST_SECTIONS = 8
LONGEST_TITLE = 100


def answer_book(fact: DataFrame, dimensions: Sequence[str] = tuple(DIMENSION_RULES)) -> DataFrame:
    """One row per (dimension, year): its ranked groups as an array of at most 50 structs.

    Year null is the answer over all years. 50 is the highest limit a question can ask for, so
    the array is complete for every question.
    """
    key = ["dimension", "in_year", "whole"]
    best = ranked(with_all_years(long_profile(fact, dimensions, by_year=True)), key, TOP_LIMIT)
    group = F.struct("rank", "dimension_value", *[c.alias(n) for n, c in profile_metrics().items()])
    lists = best.groupBy(*key).agg(F.sort_array(F.collect_list(group)).alias("groups"))
    # Every row is in one group of each dimension, so the totals depend on the year alone.
    years = fact.groupBy(F.col("discharge_year").alias("in_year")).agg(F.count("*").alias("n"))
    totals = years.rollup("in_year").agg(F.sum("n").alias("total"), (F.grouping("in_year") == 1).alias("t_whole"))
    totals = totals.withColumnRenamed("in_year", "t_year")
    same = F.col("in_year").eqNullSafe(F.col("t_year")) & (F.col("whole") == F.col("t_whole"))
    return lists.join(totals, same).select("dimension", F.col("in_year").cast("int").alias("year"), "groups", "total")


def _asked_groups(tagged: DataFrame, fact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each accepted question with its intent, ``shown`` (its groups up to the limit) and ``total``.

    Most questions share a few (dimension, year) pairs. The answer table is written first: Spark
    then knows its size and broadcasts it where that is below its threshold, so that a hot pair
    does not gather its questions in one task; a larger one joins by sort-merge, whose skewed
    partitions are split at run time.
    """
    spark = fact.sparkSession
    path = new_folder(spark, "answers")
    answer_book(fact).write.parquet(path)
    book = spark.read.parquet(path).withColumnsRenamed({"dimension": "b_dimension", "year": "b_year"})
    asked = tagged.where("accepted").select(*keys, "intent.*")
    same = (F.col("dimension") == F.col("b_dimension")) & F.col("year").eqNullSafe(F.col("b_year"))
    found = asked.join(book, same, "left")
    return found.withColumn("shown", F.slice("groups", F.lit(1), F.col("limit"))).drop("b_dimension", "b_year", "groups")


def _shown_metrics(group: str) -> dict[str, Column]:
    """The metrics of a group that the question asks for, and the ratio of a plain payment count."""
    metrics = {m: F.when(F.array_contains("metrics", m), F.col(f"{group}.{m}")) for m in METRIC_NAMES}
    only_count = F.size(F.array_except("metrics", F.array(F.lit("count")))) == 0
    share = F.round(F.col(f"{group}.count").cast("double") / F.col("total").cast("double"), 6)
    return {**metrics, "ratio": F.when((F.col("dimension") == "payment") & only_count, share)}


def answer(tagged: DataFrame, fact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per question and group: rank, value and the metrics the question asks for."""
    rows = _asked_groups(tagged, fact, keys).withColumn("g", F.explode("shown"))
    return rows.select(
        *keys, "dimension", "year", F.col("g.rank").alias("rank"), F.col("g.dimension_value").alias("dimension_value"),
        *[c.alias(n) for n, c in _shown_metrics("g").items()],
    )


def answer_summaries(tagged: DataFrame, fact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summary sentence of each accepted question, from its array of groups: nothing is exploded or regrouped."""
    rows = _asked_groups(tagged, fact, keys).withColumn("g", F.try_element_at("shown", F.lit(1)))
    top = {n: c for n, c in _shown_metrics("g").items()}
    text = sentence(F.col("dimension"), F.size("shown"), F.col("g.dimension_value"), top)
    return rows.select(*keys, "dimension", text.alias("summary"))


def dimension_label(c: Column) -> Column:
    text = c
    for name, label in A.DIMENSION_LABELS.items():
        text = F.when(c == name, label).otherwise(text)
    return text


def sentence(dimension: Column, groups: Column, value: Column, top: Mapping[str, Column]) -> Column:
    """The summary of a result with ``groups`` rows whose first one is ``value`` with the ``top`` metrics."""
    label = dimension_label(dimension)
    named = F.coalesce(F.nullif(value, F.lit("")), F.lit(UNLABELLED))
    count = F.format_number(F.coalesce(top.get("count", F.lit(None)), F.lit(0)), 0)
    text = F.format_string(LEAD_SENTENCE, label, groups.cast("string"), named, count)
    extra = {
        "ratio": lambda c: F.format_string(RATIO_SENTENCE, plain_decimals(c * 100, 1)),
        "avg_length_of_stay": lambda c: F.format_string(STAY_SENTENCE, plain_decimals(c, 1)),
        "avg_total_charges": lambda c: F.format_string(CHARGE_SENTENCE, F.format_number(c, 0)),
    }
    for name, write in extra.items():
        if name in top:
            text = F.concat(text, F.coalesce(F.when(top[name].isNotNull(), write(top[name])), F.lit("")))
    some = F.coalesce(groups, F.lit(0)) > 0
    return F.when(some, text).otherwise(F.format_string(EMPTY_SENTENCE, label))


def summarize(rows: DataFrame, keys: Sequence[str], sections: DataFrame | None = None) -> DataFrame:
    """A sentence per section of a long result (``keys``, ``dimension``, ``rank``, metrics).

    It describes the first row (rank 1); for years that is the earliest one. With ``sections``
    (the keys and ``dimension`` of every section asked for) an empty section says so.
    """
    metrics = [c for c in ("count", "ratio", "avg_length_of_stay", "avg_total_charges") if c in rows.columns]
    groups = rows.groupBy(*keys, "dimension").agg(
        F.count("*").alias("groups"), F.min_by(F.struct("dimension_value", *metrics), F.col("rank")).alias("top")
    )
    if sections is not None:
        groups = sections.select(*keys, "dimension").join(groups, [*keys, "dimension"], "left")
    top = {m: F.col(f"top.{m}") for m in metrics}
    text = sentence(F.col("dimension"), F.col("groups"), F.col("top.dimension_value"), top)
    return groups.select(*keys, "dimension", text.alias("summary"))


def report_sections(fact: DataFrame, sections: Sequence[tuple[str, str, int]] = DEFAULT_SECTIONS) -> DataFrame:
    """Long result of the report sections: ``position, title, dimension, rank``, metrics, all in one scan."""
    chosen = list(sections)
    profile = long_profile(fact, sorted({d for _, d, _ in chosen}))
    metrics = profile_metrics()
    rows = ranked(profile, ["dimension"], max(n for _, _, n in chosen))
    rows = rows.withColumn("s", F.explode(F.filter(_asked(chosen), lambda s: s["dim"] == F.col("dimension"))))
    is_payment, is_age = F.col("dimension") == "payment", F.col("dimension") == "age_group"
    return rows.where(F.col("rank") <= F.col("s.n")).select(
        F.col("s.position").alias("position"),
        F.col("s.title").alias("title"),
        "dimension",
        "rank",
        "dimension_value",
        "count",
        F.when(is_payment, A.share_of(fact)).alias("ratio"),
        F.when(is_age, metrics["avg_length_of_stay"]).alias("avg_length_of_stay"),
        F.when(~is_payment, metrics["avg_total_charges"]).alias("avg_total_charges"),
    )


def _asked(sections: Sequence[tuple[str, str, int]]) -> Column:
    """The sections as an array of (position, title, dim, n)."""
    parts = [(F.lit(i).alias("position"), F.lit(t).alias("title"), F.lit(d).alias("dim"), F.lit(n).alias("n")) for i, (t, d, n) in enumerate(sections)]
    return F.array(*[F.struct(*p) for p in parts])


def clip_request(title: str | None, sections: Sequence[tuple[str, str, int]]) -> tuple[str, list[tuple[str, str, int]]]:
    """Title and sections of a request from outside, cut to what one request may ask for."""
    return (title or REPORT_TITLE)[:LONGEST_TITLE], list(sections)[:MOST_SECTIONS]


def report(fact: DataFrame, title: str = REPORT_TITLE, sections: Sequence[tuple[str, str, int]] = DEFAULT_SECTIONS) -> DataFrame:
    """One row ``title, content``: a heading and a summary per section, in order; an empty section says so."""
    if not sections:
        raise ValueError("a report needs at least one section")
    title = title or REPORT_TITLE
    asked = fact.sparkSession.range(1).select(F.explode(_asked(sections)).alias("s"))
    asked = asked.select("s.position", "s.title", F.col("s.dim").alias("dimension"))
    texts = summarize(report_sections(fact, sections), ["position", "title"], asked)
    # The caller lists the sections, so the list is small.
    parts = F.sort_array(F.collect_list(F.struct("position", "title", "summary")))
    body = F.transform(parts, lambda p: F.concat(F.lit("## "), p["title"], F.lit("\n\n"), p["summary"], F.lit("\n")))
    return texts.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(body, "\n")).alias("content")).select(
        F.lit(title).alias("title"), "content"
    )
