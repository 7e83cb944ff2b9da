import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from wardline.operators import aggregate as A
from wardline.operators import answers, overview, profile
from wardline.operators import questions as Q


# ---- group-by ---------------------------------------------------------------------------------


def test_argument_checks(fact):
    with pytest.raises(ValueError):
        A.aggregate(fact, "unsafe_column")
    with pytest.raises(ValueError):
        A.aggregate(fact, "age_group", ["drop_table"])
    with pytest.raises(ValueError):
        A.parse_limit("101")
    with pytest.raises(ValueError):
        A.aggregate(fact, "age_group", filters={"payment": "x"})
    with pytest.raises(ValueError):
        A.aggregate(fact, "age_group", filters={"year": "abc"})
    assert A.parse_limit("x") == 20 and A.parse_limit("7") == 7
    assert A.clamp_limit(1000, 100) == 100 and A.clamp_limit(1000) == 1000 and A.clamp_limit(None) is None and A.clamp_limit(0) == 1
    assert A.parse_filters({"year": "2021", "gender": "", "other": "x"}) == {"year": "2021"}


def test_counts_and_shares_add_up(fact):
    total = fact.count()
    for dimension in A.DIMENSIONS:
        groups = A.group(fact, dimension, ["count"], A.DIMENSIONS, A.METRICS)
        assert groups.agg(F.sum("count")).first()[0] == total
    shares = A.payment_ratio(fact, 100)
    assert shares.agg(F.sum("ratio")).first()[0] == pytest.approx(1, abs=1e-5)
    assert A.payment_ratio(fact.limit(0)).count() == 0


def test_null_is_a_group_and_ties_follow_the_value(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), (None, 4)], "gender string, length_of_stay int")
    got = [tuple(r) for r in A.aggregate(df, "gender").collect()]
    assert got == [(None, 2, 3.5), ("a", 1, 2.0), ("b", 1, 1.0)]
    assert A.aggregate(df.where("gender is null"), "gender", keep_null=False).count() == 0
    assert [r[0] for r in A.dimension_values(df, "gender", 2).collect()] == ["a"]


def test_all_null_group_has_null_sums(raw):
    from wardline.operators.cleaning import strict_rows

    row = A.aggregate(strict_rows(raw({"total_charges": "bad"})), "gender", list(A.METRICS)).first()
    assert row["sum_total_charges"] is None and row["avg_total_charges"] is None and row["count"] == 1


def test_own_dimensions_and_metrics(fact):
    out = A.aggregate(
        fact, "race", ["stays"], dimensions={"race": "race"}, known_metrics={"stays": lambda: F.sum("length_of_stay")}
    )
    assert out.columns == ["dimension_value", "stays"]


def test_filter_reaches_the_partitions(fact):
    plan = A.aggregate(fact, "gender", filters={"year": 1997})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(discharge_year" in plan
    assert "ReadSchema: struct<gender:string,length_of_stay:int>" in plan


def test_overview_equals_single_queries(fact):
    filters = {"gender": "F"}
    rows = overview.overview(fact, filters).collect()
    by_section = {}
    for r in rows:
        by_section.setdefault(r["section"], []).append(r)
    diseases = A.aggregate(fact, "disease", ["count", "avg_length_of_stay", "avg_total_charges"], 8, filters).collect()
    got = sorted(by_section["diseases"], key=lambda r: r["rank"])
    assert [(r["dimension_value"], r["count"], r["avg_length_of_stay"], r["avg_total_charges"]) for r in got] == [tuple(r) for r in diseases]
    trend = A.year_trend(fact, filters).collect()
    got = sorted(by_section["trend"], key=lambda r: r["rank"])
    assert [(int(r["dimension_value"]), r["count"]) for r in got] == [(r["year"], r["count"]) for r in trend]
    summary = A.summary(fact, filters).first()
    assert by_section["summary"][0]["facilities"] == summary["facilities"]
    ratios = A.payment_ratio(fact, 20, filters).collect()
    assert [r["ratio"] for r in sorted(by_section["payments"], key=lambda r: r["rank"])] == [r["ratio"] for r in ratios]


def test_trend_flag(spark):
    one = spark.createDataFrame([(2021,), (2021,), (None,)], "discharge_year int")
    assert tuple(A.trend_available(one).first()) == (1, False)


def test_share_of_shown(spark):
    df = spark.createDataFrame([("18 to 29", 12), ("30 to 49", 20)], "dimension_value string, count bigint")
    assert rows_of(overview.share_of_shown(df).select("percent")) == [(37.5,), (62.5,)]
    assert overview.top_group(df).first()["dimension_value"] == "30 to 49"
    assert overview.gender_share(df).first()["label"] == "未知"


def test_approximate_facilities(fact):
    exact = A.distinct_facilities(fact).first()[0]
    assert abs(A.distinct_facilities(fact, approximate=True).first()[0] - exact) <= exact * 0.1


# ---- profile ----------------------------------------------------------------------------------


def test_profile_against_plain_counts(spark):
    df = spark.createDataFrame([("a", 1), (None, 3), ("b", None), ("a", 5)], "t string, n int")
    rows = {r["column_name"]: r.asDict() for r in profile.profile_columns(df).collect()}
    assert (rows["t"]["missing"], rows["t"]["distinct_values"], rows["t"]["mean"]) == (1, 2, None)
    n = rows["n"]
    assert (n["number_count"], n["min"], n["mean"], n["max"], n["std"], n["missing_rate"]) == (3, 1.0, 3.0, 5.0, 2.0, 0.25)
    assert n["distinct_values"] == 3 and n["rows"] == 4
    rough = {r["column_name"]: r.asDict() for r in profile.profile_columns(df, approximate=True).collect()}
    assert rough["t"]["distinct_values"] == 2 and rough["n"] == n


def test_birth_weight_context(raw):
    rows = raw(
        {"type_of_admission": "Newborn", "birth_weight": "3000"}, {"apr_mdc_code": "15", "birth_weight": "2500"},
        {"birth_weight": "2000"}, {"type_of_admission": "Newborn", "birth_weight": "0"},
        {"type_of_admission": "Newborn", "birth_weight": "15001", "length_of_stay": "120+"},
    )
    out = profile.birth_weight_context(rows).collect()
    assert [r["birth_weight"] for r in out] == [3000, 2500, None, None, None]
    assert out[4]["length_of_stay"] == 120 and out[4]["length_of_stay_raw"] == "120+"
    cleared = {r["rule"]: r["violations"] for r in profile.count_rules(rows, profile.anomaly_rules(2026)).collect()}
    assert cleared["birth_weight_cleared"] == 3 and cleared["invalid_length_of_stay"] == 0


def test_facility_audit(spark):
    rows = [("1", "A"), ("1", "a"), (None, " A"), ("2", ""), ("3", "  "), ("4", None), ("5", "B "), ("5", "B ")]
    df = spark.createDataFrame(rows, "permanent_facility_id string, facility_name string")
    got = {r["check_name"]: r["value"] for r in profile.facility_audit({"x": df}).collect()}
    assert got == {
        "rows": 8, "distinct_name": 5, "null_name": 1, "empty_name": 1, "blank_name": 1, "distinct_trimmed": 3,
        "distinct_case_folded": 4, "control_or_special_space": 2, "distinct_id": 5, "distinct_id_or_name": 6,
    }


def test_cross_source(fact):
    both = profile.cross_source_check({"a": fact, "b": fact}).collect()
    assert all(r["passed"] for r in both)
    assert not any(r["passed"] for r in profile.cross_source_check({"a": fact, "b": fact.union(fact)}).collect())


# ---- questions and answers --------------------------------------------------------------------

QUESTIONS = [
    ("不同年龄段的平均住院时长是多少？", "age_group", ["avg_length_of_stay", "count"], "bar", 20, None, 0.92),
    ("不同支付方式占比", "payment", ["count"], "pie", 20, None, 0.92),
    ("各年份住院量的变化趋势", "year", ["count"], "line", 20, None, 0.92),
    ("2021年疾病费用前5", "disease", ["avg_total_charges"], "bar", 5, 2021, 0.92),
    ("你好", "age_group", ["count", "avg_length_of_stay"], "bar", 20, None, 0.65),
    ("top100 医院", "hospital", ["count", "avg_length_of_stay"], "bar", 10, None, 0.92),
    ("TOP 0 性别", "gender", ["count", "avg_length_of_stay"], "bar", 1, None, 0.92),
    ("前99县", "county", ["count", "avg_length_of_stay"], "bar", 50, None, 0.92),
]


@pytest.fixture()
def asked(spark):
    return spark.createDataFrame(list(enumerate(q[0] for q in QUESTIONS)), "question_id int, query string")


def test_intents(asked):
    rows = Q.tag_intents(asked).orderBy("question_id").select("intent.*").collect()
    assert [(r.dimension, r.metrics, r.chart_type, r.limit, r.year, r.confidence) for r in rows] == [q[1:] for q in QUESTIONS]


def test_refused_questions_stay(spark):
    df = spark.createDataFrame([("  ",), ("x" * 501,), ("x" * 500,), (None,)], "query string")
    tagged = Q.tag_intents(df).collect()
    assert [r["accepted"] for r in tagged] == [False, False, True, False] and tagged[0]["intent"] is None
    assert tuple(Q.reject_counts(df).first()) == (1, 3)


def test_routes(spark):
    df = spark.createDataFrame([("医保",), ("老年",), ("收费",), ("hm",)], "query string")
    assert [r[0] for r in df.select(Q.route_of(F.col("query"))).collect()] == ["payment", "age", "disease", "trend"]


def test_answers_match_single_queries(asked, fact):
    got = answers.answer(Q.tag_intents(asked), fact, ["question_id"]).orderBy("question_id", "rank").collect()
    payments = [(r["dimension_value"], r["count"], r["ratio"]) for r in got if r["question_id"] == 1]
    assert payments == [tuple(r) for r in A.payment_ratio(fact).collect()]
    ages = [(r["dimension_value"], r["avg_length_of_stay"], r["count"]) for r in got if r["question_id"] == 0]
    assert ages == [tuple(r) for r in A.aggregate(fact, "age_group", ["avg_length_of_stay", "count"]).collect()]
    years = [int(r["dimension_value"]) for r in got if r["question_id"] == 2]
    assert years == sorted(years) and len(years) > 1
    assert not [r for r in got if r["question_id"] == 3]  # no rows in 2021
    hospitals = [r["dimension_value"] for r in got if r["question_id"] == 5]
    assert hospitals == [r[0] for r in A.aggregate(fact, "hospital", limit=10).collect()]


def test_answers_for_a_year_take_that_year(spark, fact):
    df = spark.createDataFrame([(1, "1997年性别")], "question_id int, query string")
    got = answers.answer(Q.tag_intents(df), fact, ["question_id"]).orderBy("rank").collect()
    wanted = A.aggregate(fact, "gender", filters={"year": 1997}).collect()
    assert [(r["dimension_value"], r["count"], r["avg_length_of_stay"]) for r in got] == [tuple(r) for r in wanted]


def test_summary_sentences(spark):
    df = spark.createDataFrame(
        [("s", "payment", 1, "Medicare", 1234567, 0.25, None, None), ("s", "payment", 2, "Self-Pay", 3, 0.1, None, None),
         ("t", "age_group", 1, None, 5, None, 5.25, 73305.42)],
        "key string, dimension string, rank int, dimension_value string, count bigint, ratio double, avg_length_of_stay double, avg_total_charges double",
    )
    sections = spark.createDataFrame([("s", "payment"), ("t", "age_group"), ("u", "disease")], "key string, dimension string")
    got = {r["key"]: r["summary"] for r in answers.summarize(df, ["key"], sections).collect()}
    assert got["s"] == "本次按支付方式统计，共得到 2 个分组；数量最高的是「Medicare」，共 1,234,567 条记录。其占总体的 25.0%。"
    assert got["t"] == "本次按年龄段统计，共得到 1 个分组；数量最高的是「未标注」，共 5 条记录。该组平均住院日为 5.2 天。次均费用约 73,305 元。"
    assert got["u"] == "未查询到「疾病」下的有效数据，请调整筛选条件后重试。"


def test_report(fact):
    content = answers.report(fact).first()["content"]
    assert content.startswith("# 医疗大数据洞察报告\n\n## 疾病住院量与费用\n\n本次按疾病统计，共得到 10 个分组")
    assert content.index("患者年龄结构") < content.index("支付方式构成")
    with pytest.raises(ValueError):
        answers.report(fact, sections=[])


def test_exact_sums_match_decimals(spark):
    from wardline.functions.money import exact_mean, exact_sum

    amounts = spark.range(1000).select(
        F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 5 == 0, F.lit("-0.01")).otherwise(F.lit("999999999999.99")))
        .cast("decimal(14,2)")
        .alias("total_costs")
    )
    row = amounts.agg(
        exact_sum("total_costs").alias("s"), F.sum("total_costs").cast("double").alias("d"), exact_mean("total_costs").alias("m")
    ).first()
    assert row["s"] == row["d"] and row["m"] == pytest.approx(row["d"] / amounts.where("total_costs is not null").count())
    assert amounts.limit(0).agg(exact_sum("total_costs")).first()[0] is None


def test_table_is_laid_out_by_year(spark, raw, tmp_path):
    from wardline.plans.ingest import cleaned_table
    from wardline.sources import store

    frame = raw(*({"discharge_year": str(2000 + i % 5), "facility_name": f"F{i}"} for i in range(200))).repartition(16)
    store.write_fact(store.to_fact(cleaned_table(frame)), str(tmp_path / "t"))
    files = [f for f in (tmp_path / "t").rglob("*.parquet")]
    assert len(files) == 5
