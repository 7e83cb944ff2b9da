"""The constants that queries and their SQL share, pinned by literal values."""

from wardline.functions import text as X
from wardline.operators import aggregate as A
from wardline.operators import answers, cost_model, overview, quality
from wardline.operators import questions as Q
from wardline.schema import REQUIRED


def test_dimensions_and_labels():
    assert A.DIMENSIONS == {
        "disease": "ccsr_diagnosis_description", "disease_code": "ccsr_diagnosis_code", "age_group": "age_group",
        "hospital": "facility_name", "county": "hospital_county", "service_area": "hospital_service_area",
        "year": "discharge_year", "payment": "payment_typology_1", "gender": "gender", "admission_type": "type_of_admission",
        "severity": "apr_severity_of_illness_desc", "mortality_risk": "apr_risk_of_mortality", "disposition": "patient_disposition",
    }
    assert list(A.DIMENSION_LABELS.values()) == [
        "疾病", "疾病编码", "年龄段", "医疗机构", "地区", "服务区域", "出院年份", "支付方式", "性别", "入院类型", "病情严重程度", "死亡风险", "离院去向",
    ]
    assert {k: v[0] for k, v in A.FILTERS.items()} == {
        "year": "discharge_year", "hospital": "facility_name", "county": "hospital_county",
        "service_area": "hospital_service_area", "gender": "gender",
    }
    assert (A.DEFAULT_LIMIT, A.MAX_LIMIT, A.MAX_YEARS) == (20, 100, 50)


def test_quality_rules():
    assert quality.VALID_CODES == {
        "gender": ["M", "F", "U"], "emergency_department_indicator": ["Y", "N"],
        "apr_risk_of_mortality": ["Minor", "Moderate", "Major", "Extreme", ""],
    }
    assert quality.NUMBER_FIELDS == ["length_of_stay", "total_charges", "total_costs"] and quality.FIRST_YEAR == 2000
    assert REQUIRED == [
        "facility_name", "age_group", "length_of_stay", "discharge_year", "ccsr_diagnosis_description", "payment_typology_1",
        "total_charges", "total_costs",
    ]
    assert X.MISSING_TOKENS == [
        "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
        "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
    ]


def test_questions_and_reports():
    assert Q.TOP_PATTERN == r"(?i)(?:top|前)\s*([0-9]{1,2})" and Q.YEAR_PATTERN == "((?:19|20)[0-9]{2})"
    assert (Q.DEFAULT_DIMENSION, Q.DEFAULT_METRICS, Q.DEFAULT_CHART, Q.DEFAULT_ROUTE) == ("age_group", ["count", "avg_length_of_stay"], "bar", "trend")
    assert (Q.DEFAULT_LIMIT, Q.TOP_LIMIT, Q.LONGEST_QUESTION, Q.SURE, Q.UNSURE) == (20, 50, 500, 0.92, 0.65)
    assert answers.EMPTY_SENTENCE == "未查询到「%s」下的有效数据，请调整筛选条件后重试。"
    assert answers.LEAD_SENTENCE == "本次按%s统计，共得到 %s 个分组；数量最高的是「%s」，共 %s 条记录。"
    assert (answers.RATIO_SENTENCE, answers.STAY_SENTENCE, answers.CHARGE_SENTENCE) == ("其占总体的 %s%%。", "该组平均住院日为 %s 天。", "次均费用约 %s 元。")
    assert answers.DEFAULT_SECTIONS == [("疾病住院量与费用", "disease", 10), ("患者年龄结构", "age_group", 10), ("支付方式构成", "payment", 20)]
    assert answers.clip_request("x" * 200, answers.DEFAULT_SECTIONS * 4) == ("x" * 100, (answers.DEFAULT_SECTIONS * 4)[:8])


def test_overview_and_model():
    assert overview.SECTIONS == [
        ("trend", "year", 50), ("diseases", "disease", 8), ("ages", "age_group", 10), ("payments", "payment", 20),
        ("genders", "gender", 10), ("severity", "severity", 10),
    ]
    assert (overview.UNLABELLED, overview.GENDER_LABELS, overview.UNKNOWN_GENDER) == ("未标注", {"F": "女性", "M": "男性"}, "未知")
    assert cost_model.FEATURES == [
        "age_group", "gender", "type_of_admission", "ccsr_diagnosis_code", "apr_severity_of_illness_desc", "apr_risk_of_mortality",
        "apr_medical_surgical_desc", "emergency_department_indicator", "payment_typology_1",
    ]
    assert (cost_model.TARGET, cost_model.TRAIN_SHARE, cost_model.SEED) == ("total_costs", 0.8, 42)
