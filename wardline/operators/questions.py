"""Tagging a table of questions with the analysis each one asks for.

Rules are ordered keyword lists, turned into one column expression each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import contains_any

Rules = Mapping[str, Sequence[str]]

# Keywords per dimension, metric and chart, in order of precedence.
DIMENSION_RULES: Rules = {
    "disease": ["疾病", "病种", "诊断", "什么病"],
    "age_group": ["年龄", "年龄段", "年龄段分布"],
    "hospital": ["医院", "医疗机构", "哪个医院"],
    "county": ["县", "地区", "郡"],
    "service_area": ["服务区域", "区域"],
    "year": ["年份", "年度", "趋势", "哪一年", "逐年"],
    "payment": ["支付方式", "医保", "付费", "支付"],
    "gender": ["性别"],
    "admission_type": ["入院类型", "入院方式"],
    "severity": ["严重程度", "病情严重"],
}
METRIC_RULES: Rules = {
    "avg_length_of_stay": ["住院时长", "住院天数", "住院时间", "平均住院"],
    "sum_total_charges": ["总费用", "费用总额", "总花费"],
    "avg_total_charges": ["费用", "花费", "金额", "收费", "平均费用"],
    "avg_total_costs": ["成本", "平均成本"],
    "count": ["数量", "人数", "住院量", "例数", "多少", "占比", "比例"],
}
CHART_RULES: Rules = {
    "pie": ["占比", "比例", "分布", "构成"],
    "line": ["趋势", "变化", "逐年", "年份"],
}
# The dashboard's own routing patterns.
ROUTE_PATTERNS = {
    "payment": "支付|医保|保险",
    "age": "年龄|老年|患者",
    "disease": "费用|成本|收费|疾病",
}
DEFAULT_DIMENSION = "age_group"
DEFAULT_METRICS = ["count", "avg_length_of_stay"]
DEFAULT_CHART = "bar"
DEFAULT_ROUTE = "trend"
DEFAULT_LIMIT, TOP_LIMIT = 20, 50
LONGEST_QUESTION = 500
TOP_PATTERN = r"(?i)(?:top|前)\s*([0-9]{1,2})"
YEAR_PATTERN = r"((?:19|20)[0-9]{2})"
SURE, UNSURE = 0.92, 0.65


def _first_match(c: Column, rules: Rules, default: str) -> Column:
    tags = [F.when(contains_any(c, words), F.lit(name)) for name, words in rules.items()]
    return F.coalesce(*tags, F.lit(default))


def dimension_of(c: Column, rules: Rules = DIMENSION_RULES, default: str = DEFAULT_DIMENSION) -> Column:
    """The first dimension with a keyword in the text."""
    return _first_match(c, rules, default)


def metrics_of(c: Column, rules: Rules = METRIC_RULES, default: Sequence[str] = DEFAULT_METRICS) -> Column:
    """Every metric with a keyword in the text, in rule order."""
    found = F.array_compact(F.array(*[F.when(contains_any(c, w), F.lit(n)) for n, w in rules.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(m) for m in default]))


def chart_of(c: Column, rules: Rules = CHART_RULES, default: str = DEFAULT_CHART) -> Column:
    return _first_match(c, rules, default)


def limit_of(c: Column) -> Column:
    """The number after "top" in 1..50, two digits at most; 20 without one."""
    number = F.nullif(F.regexp_extract(c, TOP_PATTERN, 1), F.lit("")).cast("int")
    kept = F.least(F.greatest(number, F.lit(1)), F.lit(TOP_LIMIT))
    return F.when(number.isNull(), F.lit(DEFAULT_LIMIT)).otherwise(kept)


def year_of(c: Column) -> Column:
    """The first 19xx or 20xx in the text, null without one."""
    return F.nullif(F.regexp_extract(c, YEAR_PATTERN, 1), F.lit("")).cast("int")


def confidence_of(c: Column, rules: Rules = DIMENSION_RULES) -> Column:
    every = [w for words in rules.values() for w in words]
    return F.when(contains_any(c, every), F.lit(SURE)).otherwise(F.lit(UNSURE))


def intent_of(
    c: Column, dimensions: Rules = DIMENSION_RULES, metrics: Rules = METRIC_RULES, charts: Rules = CHART_RULES
) -> Column:
    return F.struct(
        dimension_of(c, dimensions).alias("dimension"),
        metrics_of(c, metrics).alias("metrics"),
        chart_of(c, charts).alias("chart_type"),
        limit_of(c).alias("limit"),
        year_of(c).alias("year"),
        confidence_of(c, dimensions).alias("confidence"),
    )


def acceptable(c: Column, longest: int | None = LONGEST_QUESTION) -> Column:
    """Not blank and at most ``longest`` characters (``None``: of any length)."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    fits = F.length(trimmed) > 0 if longest is None else F.length(trimmed).between(1, longest)
    return F.coalesce(fits, F.lit(False))


def tag_intents(questions: DataFrame, query: str = "query", longest: int | None = LONGEST_QUESTION, **rules: Rules) -> DataFrame:
    """Add ``accepted`` and ``intent``; a refused question (blank, or over ``longest``) stays, with a null intent."""
    ok = acceptable(F.col(query), longest)
    return questions.withColumn("accepted", ok).withColumn("intent", F.when(ok, intent_of(F.col(query), **rules)))


def reject_counts(questions: DataFrame, query: str = "query", longest: int | None = LONGEST_QUESTION) -> DataFrame:
    ok = acceptable(F.col(query), longest)
    return questions.agg(F.count(F.when(ok, 1)).alias("accepted"), F.count(F.when(~ok, 1)).alias("rejected"))


def route_of(c: Column, patterns: Mapping[str, str] = ROUTE_PATTERNS, default: str = DEFAULT_ROUTE) -> Column:
    """The first view whose pattern is found in the text."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(name)) for name, p in patterns.items()], F.lit(default))
