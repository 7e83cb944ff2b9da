"""Column contract and table schemas for discharge records."""

from __future__ import annotations

from pyspark.sql import types as T

# Source headers and table column names, in file order.
COLUMNS: list[tuple[str, str]] = [
    ("Hospital Service Area", "hospital_service_area"),
    ("Hospital County", "hospital_county"),
    ("Operating Certificate Number", "operating_certificate_number"),
    ("Permanent Facility Id", "permanent_facility_id"),
    ("Facility Name", "facility_name"),
    ("Age Group", "age_group"),
    ("Zip Code - 3 digits", "zip_code_3"),
    ("Gender", "gender"),
    ("Race", "race"),
    ("Ethnicity", "ethnicity"),
    ("Length of Stay", "length_of_stay"),
    ("Type of Admission", "type_of_admission"),
    ("Patient Disposition", "patient_disposition"),
    ("Discharge Year", "discharge_year"),
    ("CCSR Diagnosis Code", "ccsr_diagnosis_code"),
    ("CCSR Diagnosis Description", "ccsr_diagnosis_description"),
    ("CCSR Procedure Code", "ccsr_procedure_code"),
    ("CCSR Procedure Description", "ccsr_procedure_description"),
    ("APR DRG Code", "apr_drg_code"),
    ("APR DRG Description", "apr_drg_description"),
    ("APR MDC Code", "apr_mdc_code"),
    ("APR MDC Description", "apr_mdc_description"),
    ("APR Severity of Illness Code", "apr_severity_of_illness_code"),
    ("APR Severity of Illness Description", "apr_severity_of_illness_desc"),
    ("APR Risk of Mortality", "apr_risk_of_mortality"),
    ("APR Medical Surgical Description", "apr_medical_surgical_desc"),
    ("Payment Typology 1", "payment_typology_1"),
    ("Payment Typology 2", "payment_typology_2"),
    ("Payment Typology 3", "payment_typology_3"),
    ("Birth Weight", "birth_weight"),
    ("Emergency Department Indicator", "emergency_department_indicator"),
    ("Total Charges", "total_charges"),
    ("Total Costs", "total_costs"),
]

HEADERS = [header for header, _ in COLUMNS]
NAMES = [name for _, name in COLUMNS]
HEADER_TO_NAME = dict(COLUMNS)

MONEY = T.DecimalType(14, 2)

TYPED: dict[str, T.DataType] = {
    "length_of_stay": T.IntegerType(),
    "discharge_year": T.ShortType(),
    "apr_severity_of_illness_code": T.ShortType(),
    "total_charges": MONEY,
    "total_costs": MONEY,
}
MONEY_COLUMNS = ["total_charges", "total_costs"]
TEXT_COLUMNS = [name for name in NAMES if name not in TYPED]

# The fields a record must have, also the critical fields of the quality scores.
REQUIRED = [
    "facility_name",
    "age_group",
    "length_of_stay",
    "discharge_year",
    "ccsr_diagnosis_description",
    "payment_typology_1",
    "total_charges",
    "total_costs",
]

RAW_HEADER_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in HEADERS])
RAW_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in NAMES])
CLEAN_SCHEMA = T.StructType([T.StructField(n, TYPED.get(n, T.StringType())) for n in NAMES])

# The stored table: the clean row, how many source rows it stands for, its identity, its load time.
FACT_SCHEMA = T.StructType(
    CLEAN_SCHEMA.fields
    + [
        T.StructField("source_rows", T.LongType()),
        T.StructField("row_hash", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)
PARTITION_COLUMN = "discharge_year"

QUALITY_SCHEMA = T.StructType(
    [
        T.StructField(n, T.DoubleType())
        for n in ("completeness", "accuracy", "consistency", "timeliness", "uniqueness", "overall")
    ]
    + [T.StructField("sample_size", T.LongType())]
)

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("event_seq", T.LongType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_size_bytes", T.LongType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("chunks_processed", T.IntegerType()),
        T.StructField("rows_read", T.LongType()),
        T.StructField("rows_inserted", T.LongType()),
        T.StructField("rows_dropped", T.LongType()),
        T.StructField("quality_json", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("rows_rejected", T.LongType()),
    ]
)
