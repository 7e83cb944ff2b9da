import decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from wardline.operators import cleaning as C
from wardline.operators.dedup import drop_duplicates, duplicate_rate


def column(df, name):
    return [r[name] for r in df.collect()]


def test_money_text(spark):
    df = spark.createDataFrame(
        [("320,922.43", "60,241.34"), ("1,234.00", "100"), ("$500", "80"), (" 7 ", None), ("", "bad"), ("inf", "nan"), ("1e2", "0x10"), ("1d", "1e999")],
        "total_charges string, total_costs string",
    )
    out = C.clean_money(df)
    assert column(out, "total_charges") == [320922.43, 1234.0, 500.0, 7.0, None, None, 100.0, None]
    assert column(out, "total_costs") == [60241.34, 100.0, 80.0, None, None, None, None, None]


def test_birth_weight_only_for_newborns(spark):
    df = spark.createDataFrame(
        [("Newborn", "03100"), ("Emergency", "N/A"), ("Newborn", "02800"), (None, "1")],
        "type_of_admission string, birth_weight string",
    )
    assert column(C.clean_birth_weight(df), "birth_weight") == ["03100", None, "02800", None]


STAYS = [("3", 3, 3), ("120 +", 120, 120), ("120+", 120, None), ("-1", 1, None), ("3.7", 3, None), (None, None, None), ("", None, None)]


def test_stay_in_both_profiles(spark, raw):
    df = raw(*[{"length_of_stay": s, "zip_code_3": str(i)} for i, (s, _, _) in enumerate(STAYS)])
    strict = C.strict_rows(df).orderBy("zip_code_3")
    relaxed = C.clean_relaxed(df).orderBy("zip_code_3")
    assert column(strict, "length_of_stay") == [s[2] for s in STAYS]
    assert column(relaxed, "length_of_stay") == [s[1] for s in STAYS]


def test_negative_and_odd_amounts(raw):
    df = raw(*[{"total_charges": c, "zip_code_3": str(i)} for i, c in enumerate(["-5", "1e5", "1.005", "$1,000", "5\r", None])])
    strict = column(C.strict_rows(df).orderBy("zip_code_3"), "total_charges")
    assert strict == [None, None, decimal.Decimal("1.01"), decimal.Decimal("1000.00"), decimal.Decimal("5.00"), None]
    relaxed = column(C.clean_relaxed(df).orderBy("zip_code_3"), "total_charges")
    assert relaxed == [0.0, 100000.0, 1.005, 1000.0, 5.0, None]


def test_strict_text_and_codes(raw):
    out = C.strict_rows(
        raw({"facility_name": "  A ", "race": "  ", "gender": "", "apr_severity_of_illness_code": "256", "discharge_year": "2021.5"})
    ).first()
    assert (out["facility_name"], out["race"], out["gender"]) == ("A", None, None)
    assert out["apr_severity_of_illness_code"] is None and out["discharge_year"] is None
    assert out["permanent_facility_id"] == "0001"


def test_relaxed_fill_keeps_null_birth_weight(raw):
    rows = C.clean_relaxed(
        raw({"race": None, "birth_weight": "100"}, {"type_of_admission": "Newborn", "birth_weight": None, "gender": "N/A"}),
        {"race": "Unknown"},
    ).collect()
    by_type = {r["type_of_admission"]: r for r in rows}
    assert by_type["Emergency"]["birth_weight"] is None and by_type["Emergency"]["race"] == "Unknown"
    assert by_type["Newborn"]["birth_weight"] == "" and by_type["Newborn"]["gender"] == ""


def test_whole_year_as_float_is_kept(raw):
    out = C.clean_relaxed(raw({"discharge_year": "2021.0"}, {"discharge_year": "2021.5"}))
    assert sorted(column(out, "discharge_year"), key=str) == [2021, None]


def test_strict_counts_copies_after_cleaning(raw):
    out = C.strict_table(raw({}, {"facility_name": " A "}, {"facility_name": "B"}))
    assert rows_of(out.select("facility_name", "source_rows")) == [("A", 2), ("B", 1)]


def test_stats_judge_required_fields_before_the_fill(raw):
    empty = dict.fromkeys(
        ["facility_name", "age_group", "length_of_stay", "discharge_year", "ccsr_diagnosis_description",
         "payment_typology_1", "total_charges", "total_costs"]
    )
    frame = raw({}, {}, empty, {**empty, "total_costs": "7"})
    assert C.clean_stats(frame).first().asDict() == {
        "rows_read": 4, "rows_after_clean": 2, "duplicates_removed": 1, "invalid_rows_removed": 1,
    }
    assert C.relaxed_table(frame).count() == 2


@pytest.mark.parametrize("keep,left", [("first", 2), (False, 1)])
def test_whole_row_dedup(spark, keep, left):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "a int, b int")
    assert drop_duplicates(df, keep=keep).count() == left


def test_subset_dedup(spark):
    df = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("y", 3, "r")], "k string, n int, v string")
    assert rows_of(drop_duplicates(df, ["k"], "first", ["n"])) == [("x", 1, "p"), ("y", 3, "r")]
    assert rows_of(drop_duplicates(df, ["k"], "last", ["n"])) == [("x", 2, "q"), ("y", 3, "r")]
    assert rows_of(drop_duplicates(df, ["k"], False)) == [("y", 3, "r")]
    with pytest.raises(ValueError):
        drop_duplicates(df, ["k"])
    with pytest.raises(ValueError):
        drop_duplicates(df, ["k"], "any", ["n"])


def test_hot_group_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    out = drop_duplicates(df, ["k"], "first", ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Partial") and "WindowGroupLimit" in plan
    assert out.count() == df.select("k").distinct().count()


def test_duplicate_rate_and_estimate(spark):
    df = spark.range(9000).select(F.sha2((F.col("id") % 6000).cast("string"), 256).alias("row_hash"))
    exact = duplicate_rate(df).first()
    assert (exact["rows_examined"], exact["distinct_rows"], exact["duplicate_rows"]) == (9000, 6000, 3000)
    estimate = duplicate_rate(df, fraction=0.3).first()
    assert abs(estimate["duplicate_rate"] - 1 / 3) < 0.03 and estimate["rows_examined"] < 4000
    assert duplicate_rate(df.limit(0)).first()["duplicate_rate"] == 0.0


def test_only_rows_that_may_have_copies_are_shuffled_whole(spark):
    """Rows without a copy stay in place; those with one are folded, whatever the type, nulls and sign of their hash."""
    from wardline.operators.dedup import fold_copies

    rows = spark.range(4000).select((F.col("id") % 3000).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("x"), F.col("id") % 3000)).alias("b"), F.lit(2).alias("w"))
    found = fold_copies(rows, ["a", "b"])
    expected = rows.groupBy("a", "b").agg(F.count("*").alias("source_rows"))
    assert found.exceptAll(expected).isEmpty() and found.count() == expected.count() == 3000
    assert found.where("source_rows = 2").count() == 1000
    weighted = fold_copies(rows, ["a", "b"], "w").agg(F.sum("source_rows"), F.count("*")).first()
    assert tuple(weighted) == (8000, 3000)
    assert fold_copies(rows.limit(0), ["a", "b"]).isEmpty()
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
