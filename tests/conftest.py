import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardline.schema import HEADERS, NAMES, RAW_SCHEMA  # noqa: E402
from wardline.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"

RECORD = {
    "hospital_service_area": "Hudson Valley", "hospital_county": "Ulster", "operating_certificate_number": "0101",
    "permanent_facility_id": "0001", "facility_name": "A", "age_group": "30 to 49", "zip_code_3": "124",
    "gender": "F", "race": "White", "ethnicity": "Unknown", "length_of_stay": "3", "type_of_admission": "Emergency",
    "patient_disposition": "Home", "discharge_year": "2021", "ccsr_diagnosis_code": "D1",
    "ccsr_diagnosis_description": "Disease A", "ccsr_procedure_code": "P1", "ccsr_procedure_description": "Proc",
    "apr_drg_code": "001", "apr_drg_description": "DRG", "apr_mdc_code": "05", "apr_mdc_description": "MDC",
    "apr_severity_of_illness_code": "2", "apr_severity_of_illness_desc": "Moderate", "apr_risk_of_mortality": "Minor",
    "apr_medical_surgical_desc": "Medical", "payment_typology_1": "Medicare", "payment_typology_2": None,
    "payment_typology_3": None, "birth_weight": None, "emergency_department_indicator": "Y",
    "total_charges": "1,200.50", "total_costs": "800",
}


def record(**changes):
    return {**RECORD, **changes}


def line(**changes):
    """One CSV line with every field quoted as needed."""
    out = []
    for name in NAMES:
        value = record(**changes)[name]
        text = "" if value is None else str(value)
        out.append('"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text)
    return ",".join(out)


def write_csv(path, lines, headers=HEADERS, bom=False):
    text = "\n".join([",".join(headers), *lines]) + "\n"
    path.write_text(("﻿" if bom else "") + text, encoding="utf-8")
    return str(path)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    def build(*rows):
        return spark.createDataFrame([tuple(record(**r)[n] for n in NAMES) for r in rows], RAW_SCHEMA)

    return build


@pytest.fixture(scope="session")
def fact(spark):
    from wardline.plans import tables

    return tables.fact(spark, SF)


@pytest.fixture(scope="session")
def stage(spark):
    from wardline.plans import tables

    return tables.stage(spark, SF)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
