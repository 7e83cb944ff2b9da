import pytest

from wardline.operators import cleaning, quality
from wardline.plans import tables
from conftest import SF

COLUMNS = [
    "facility_name", "age_group", "length_of_stay", "discharge_year", "ccsr_diagnosis_description",
    "payment_typology_1", "total_charges", "total_costs", "gender", "emergency_department_indicator",
    "apr_risk_of_mortality",
]
ROWS = [
    ("A", "30 to 49", "3", "2021", "Disease A", "Medicare", "1,200", "800", "F", "Y", "Minor"),
    ("B", "50 to 69", "-1", "1999", "Disease B", "Medicaid", "bad", "-2", "X", "?", "Unknown"),
]


@pytest.fixture()
def frame(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in COLUMNS))


def test_report(frame):
    report = quality.assess(frame, 2026).first().asDict()
    assert report == {
        "completeness": 1.0, "accuracy": 0.5, "consistency": 0.5, "timeliness": 0.5, "uniqueness": 1.0,
        "sample_size": 2, "overall": 0.625,
    }


def test_chunks_add_up_to_the_whole(frame):
    chunks = frame.withColumn("_chunk", frame["facility_name"])
    merged = quality.report(quality.merge_sums(quality.quality_sums(chunks, 2026, ["_chunk"])))
    assert merged.first() == quality.assess(frame, 2026).first()


def test_dollar_sign_is_not_a_number_for_the_score(spark):
    df = spark.createDataFrame([("$500",), ("500",), ("inf",), (None,)], "total_charges string")
    assert quality.score("accuracy", df, 2026).first()[0] == 0.25


def test_empty_frame_scores_zero(frame):
    report = quality.assess(frame.limit(0), 2026).first().asDict()
    assert set(report.values()) == {0, 0.0}


def test_absent_columns_do_not_count(spark):
    df = spark.createDataFrame([("A", None), ("", "x")], "facility_name string, age_group string")
    assert quality.score("completeness", df, 2026).first()[0] == 0.5


def test_uniqueness_on_a_subset(frame):
    assert quality.uniqueness(frame.union(frame)).first()[0] == 0.5
    assert quality.uniqueness(frame, ["facility_name"]).first()[0] == 1.0


def test_strict_report_reads_counters_from_the_table(raw):
    table = cleaning.strict_table(raw({}, {}, {"gender": "X"}, {"facility_name": None}))
    report = quality.strict_report(table, 2026).first()
    assert report["sample_size"] == 4 and report["uniqueness"] == 0.75
    assert report["consistency"] == 0.6667 and report["completeness"] == 0.6667


def test_fixture_scores(spark):
    row = quality.strict_scores(tables.fact(spark, SF), 2026).first()
    assert all(0 < row[n] <= 1 for n in quality.SCORES)
