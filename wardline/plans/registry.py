"""Named queries over a data folder: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import fixtures
from wardline.functions import text as X
from wardline.functions.identity import row_hash
from wardline.operators import aggregate as A
from wardline.operators import answers, boosting, cleaning, cost_model, dedup, hashtree, overview, profile, quality, sketches
from wardline.operators import questions as Q
from wardline.plans import cube, incremental, tables
from wardline.plans.ingest import cleaned_table, reconcile
from wardline.schema import HEADER_TO_NAME, HEADERS, NAMES, RAW_SCHEMA, TEXT_COLUMNS
from wardline.session import new_folder
from wardline.sources import commits, ledger, readers, store
from wardline.streaming import ingest as stream
from wardline.streaming import state

Query = Callable[[SparkSession, str], DataFrame]

LAST_YEAR = 2026
DEDUP_KEYS = ["facility_name", "age_group", "discharge_year"]
SINGLE_KEYS = ["permanent_facility_id", "ccsr_diagnosis_code", "patient_disposition", "length_of_stay"]
SPARSE = ["ethnicity", "ccsr_diagnosis_description", "ccsr_procedure_code", "gender", "payment_typology_2", "payment_typology_3"]
FILTERS = {"year": "1997", "gender": "F", "service_area": "ASIA", "county": ""}
# Of the queries that have SQL, which names it; small enough that the smallest tables are sampled as well.
FIT_ROWS = 2_000
# The survey's training sample (D16).
MODEL_ROWS = 200_000
STREAM_FILES = 3

# Extra keywords in the languages of the conversations, added to the default rules.
LOCAL_DIMENSIONS = {
    **Q.DIMENSION_RULES,
    "hospital": [*Q.DIMENSION_RULES["hospital"], "heit"],
    "county": [*Q.DIMENSION_RULES["county"], "ción"],
    "gender": [*Q.DIMENSION_RULES["gender"], "elle"],
    "severity": [*Q.DIMENSION_RULES["severity"], "ing"],
}
LOCAL_METRICS = {
    **Q.METRIC_RULES,
    "avg_total_costs": [*Q.METRIC_RULES["avg_total_costs"], "ment"],
    "count": [*Q.METRIC_RULES["count"], "tion"],
}
LOCAL_CHARTS = {"pie": [*Q.CHART_RULES["pie"], "ung"], "line": [*Q.CHART_RULES["line"], "and"]}

_stage, _fact = tables.stage, tables.fact


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return Q.tag_intents(fixtures.questions(spark, d))


def _question_tag(column: Callable, name: str) -> Query:
    return lambda spark, d: fixtures.questions(spark, d).select("conv_id", "turn", column(F.col("query")).alias(name))


# ---- sources and sinks ------------------------------------------------------------------------


def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    return readers.project_canonical(readers.read_source(spark, tables.csv_folder(spark, d), "csv"))


def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    return readers.project_canonical(readers.read_source(spark, tables.json_folder(spark, d), "json"))


def scan_csv_multiline(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose facility names hold line breaks, written as text and read again."""
    names = {n: h for h, n in HEADER_TO_NAME.items()}
    rows = _stage(spark, d).withColumn("facility_name", F.replace("facility_name", F.lit(" "), F.lit("\n"))).withColumnsRenamed(names)
    folder = new_folder(spark, "broken_lines")
    writer = rows.write.options(**tables.TEXT_FILES).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return readers.project_canonical(readers.read_source(spark, folder, "csv", multiline=readers.SPLIT))


def project_canonical(spark: SparkSession, d: str) -> DataFrame:
    headers = {n: h for h, n in HEADER_TO_NAME.items()}
    source = _stage(spark, d).withColumnsRenamed(headers)
    return readers.project_canonical(source.select(*reversed(source.columns)))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    target = new_folder(spark, "stream")
    table = stream.ingest_stream(spark, tables.csv_folder(spark, d), target, max_files=STREAM_FILES, last_year=LAST_YEAR)
    return table.select("row_hash", "discharge_year", "facility_name", "length_of_stay", "total_charges", "total_costs")


def stream_state_dedup(spark: SparkSession, d: str) -> DataFrame:
    target = new_folder(spark, "state")
    table = state.ingest_state(spark, tables.csv_folder(spark, d), target, max_files=STREAM_FILES)
    return table.select("row_hash", "discharge_year", "facility_name", "length_of_stay", "total_charges", "total_costs")


def uncommitted_load(spark: SparkSession, d: str) -> DataFrame:
    """Three loads of which the second breaks before its commit: its rows are not in the table, nor does it hold up the third."""
    fact, target = _fact(spark, d), new_folder(spark, "committed")
    commits.load(spark, target, "a", fact.where("age_group = '0 to 17'"))

    def broken() -> None:
        raise InterruptedError("the load ends here")

    try:
        commits.load(spark, target, "b", commits.absent(fact.where("gender = 'F'"), target).select(fact.columns), before_commit=broken)
    except InterruptedError:
        pass
    commits.load(spark, target, "c", commits.absent(fact.where("gender = 'M'"), target).select(fact.columns))
    return commits.read_loads(spark, target).select("load", "row_hash", "source_rows", "total_costs", "discharge_year")


def bad_records(spark: SparkSession, d: str) -> DataFrame:
    """Records written as text: negative stays get a field too many, blank stays one too few."""
    rows = _stage(spark, d)
    quoted = F.concat(F.lit('"'), F.coalesce("total_charges", F.lit("")), F.lit('"'))
    extra = F.when(F.col("length_of_stay") == "-1", F.lit(",x"))
    tail = F.when(F.col("length_of_stay") == "", F.lit("")).otherwise(F.concat(F.lit(","), F.col("total_costs")))
    line = F.concat(F.col("permanent_facility_id"), F.lit(","), quoted, tail, F.coalesce(extra, F.lit("")))
    folder = new_folder(spark, "lines")
    rows.select(line.alias("value")).write.text(folder)
    schema = readers.text_schema(["permanent_facility_id", "total_charges", "total_costs"], corrupt=True)
    options = {**readers.csv_options("csv", multiline=False), "header": False}
    return readers.bad_record_counts(spark.read.options(**options).schema(schema).csv(folder))


def _with_long_rows(spark: SparkSession, d: str) -> str:
    """The staged rows as CSV lines; stays of -1 get a field too many."""
    rows = _stage(spark, d)
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(n), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for n in NAMES]
    line = F.concat(F.concat_ws(",", *cells), F.when(F.col("length_of_stay") == "-1", ",x").otherwise(""))
    folder = new_folder(spark, "long")
    # One column without separator and quotes whose name is the header, so that the writer puts that into every file.
    header = ",".join(f'"{name}"' for name in HEADERS)
    plain = {"compression": "gzip", "header": True, "sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(line.alias(header)).write.options(**plain).csv(folder)
    return folder


def stream_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a stream whose rows of negative stay are a field too long, and the reasons in its quarantine."""
    target = new_folder(spark, "stream")
    stream.ingest_stream(spark, _with_long_rows(spark, d), target, max_files=STREAM_FILES, last_year=LAST_YEAR, most_rejects=2**62)
    state = ledger.latest_run(stream.read_stream_ledger(spark, target))
    kept = spark.read.parquet(f"{target}/rejected").agg(F.count("*").alias("quarantined"), F.max("reason").alias("reason"))
    counters = state.select("status", "rows_read", "rows_inserted", "rows_dropped", "rows_rejected")
    return counters.select("*", *(kept.select(c).scalar().alias(c) for c in kept.columns))


def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The last state of a stream's run in the ledger."""
    target = new_folder(spark, "stream")
    stream.ingest_stream(spark, tables.csv_folder(spark, d), target, max_files=STREAM_FILES, last_year=LAST_YEAR, run_id=7)
    state = ledger.latest_run(stream.read_stream_ledger(spark, target))
    ended = (F.col("finished_at") >= F.col("started_at")).alias("ended")
    return state.select("run_id", "status", ended, "rows_read", "rows_inserted", "rows_dropped", "rows_rejected", "quality.sample_size", "quality.overall")


def row_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return reconcile(_fact(spark, d), tables.loads(spark, d))


def reconcile_after_insert(spark: SparkSession, d: str) -> DataFrame:
    """All staged rows inserted into an empty table, and the rows of one age group once more."""
    target, rows = new_folder(spark, "inserts"), _stage(spark, d)
    incremental.insert_new(spark, rows, target)
    incremental.insert_new(spark, rows.where("age_group = '0 to 17'"), target)
    return reconcile(store.read_fact(spark, target), store.read_loads(spark, target))


def relaxed_identity(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the relaxed table, its distinct identities, and the source rows they stand for."""
    table = cleaned_table(_stage(spark, d), "relaxed", in_place=True)
    return table.agg(F.count("*").alias("rows"), F.countDistinct(F.unhex("row_hash")).alias("identities"), F.sum("source_rows").alias("source_rows"))



def ledger_state(spark: SparkSession, d: str) -> DataFrame:
    state = ledger.latest_per_run(fixtures.ledger_events(spark, d))
    return state.withColumn("started_at", X.iso_time(F.col("started_at"))).drop("finished_at")


def ledger_latest(spark: SparkSession, d: str) -> DataFrame:
    latest = ledger.latest_run(fixtures.ledger_events(spark, d))
    return latest.select(
        "run_id", "status", "source_file", "started_at", "finished_at", "rows_read", "rows_inserted", "rows_dropped",
        "error_message", "quality.overall", "quality.sample_size",
    )


# ---- cleaning ---------------------------------------------------------------------------------


def _strict(names: list[str]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = cleaning.strict_rows(_stage(spark, d))
        return rows.select(F.col("permanent_facility_id").alias("facility"), *names)

    return run


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return _stage(spark, d).withColumn("row_hash", row_hash(NAMES))


def _dedup(keep: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _hashed(spark, d).select(*DEDUP_KEYS, "total_charges", "row_hash")
        return dedup.drop_duplicates(rows, DEDUP_KEYS, keep, ["row_hash"])

    return run


def dedup_none(spark: SparkSession, d: str) -> DataFrame:
    rows = _stage(spark, d).select(*SINGLE_KEYS, "total_charges")
    return dedup.drop_duplicates(rows, SINGLE_KEYS, False)


def clean_money(spark: SparkSession, d: str) -> DataFrame:
    rows = _stage(spark, d).select("total_charges", "total_costs", F.col("total_charges").alias("charges_text"))
    return cleaning.clean_money(rows)


def clean_money_floor(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.money_floor(clean_money(spark, d))


def clean_birth_weight(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_birth_weight(_stage(spark, d).select("type_of_admission", "birth_weight"))


def clean_los_relaxed(spark: SparkSession, d: str) -> DataFrame:
    rows = _stage(spark, d).select("length_of_stay", F.col("length_of_stay").alias("stay_text"))
    return cleaning.normalize_types(rows)


def clean_types(spark: SparkSession, d: str) -> DataFrame:
    rows = _stage(spark, d).select(
        "permanent_facility_id", "length_of_stay", "discharge_year", "apr_severity_of_illness_code",
        "total_charges", "total_costs",
    )
    return cleaning.normalize_types(cleaning.clean_money(rows))


def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.handle_missing(_stage(spark, d).select(*SPARSE), {"ethnicity": "Unknown"})


# ---- quality ----------------------------------------------------------------------------------


def _score(name: str) -> Query:
    return lambda spark, d: quality.score(name, _stage(spark, d), LAST_YEAR)


def q_accumulate(spark: SparkSession, d: str) -> DataFrame:
    rows = _stage(spark, d).withColumn("_chunk", F.col("permanent_facility_id"))
    return quality.report(quality.merge_sums(quality.quality_sums(rows, LAST_YEAR, ["_chunk"])))


def q_cells(spark: SparkSession, d: str) -> DataFrame:
    rules, row_rule = profile.clean_rules(LAST_YEAR), profile.consistent_row(LAST_YEAR)
    return quality.cell_scores(_fact(spark, d), NAMES, rules, row_rule)


# ---- audits and identity ----------------------------------------------------------------------


def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_columns(_fact(spark, d), NAMES).withColumn("std", F.round("std", 4))


def birth_weight_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _stage(spark, d).select("type_of_admission", "apr_mdc_code", "apr_drg_code", "birth_weight", "length_of_stay")
    return profile.birth_weight_context(rows)


def cross_source_check(spark: SparkSession, d: str) -> DataFrame:
    # The distinct rows of each copy as identity (32 bytes) and facility: the shuffle carries these, not 33 columns.
    slim = lambda raw: cleaning.strict_rows(raw).select(F.unhex(row_hash(NAMES)).alias("identity"), "facility_name").distinct()
    copies = {"stage": slim(_stage(spark, d)), "csv": slim(scan_csv(spark, d)), "table": _fact(spark, d)}
    return profile.cross_source_check(copies)


def _loads(fact: DataFrame) -> dict[str, DataFrame]:
    """The table as two loads."""
    young = F.coalesce(F.col("age_group") == "0 to 17", F.lit(False))
    return {"first": fact.where(young), "second": fact.where(~young)}


def profile_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values from the stored sketches of two loads, held to the exact counts."""
    path = new_folder(spark, "sketches")
    for load, rows in _loads(_fact(spark, d)).items():
        sketches.store_sketches(rows, path, load, NAMES)
    return sketches.held_to_exact(sketches.merged_profile(spark, path), _fact(spark, d), NAMES)


def _cube(spark: SparkSession, d: str) -> str:
    path = new_folder(spark, "cube")
    for load, rows in _loads(_fact(spark, d)).items():
        cube.add_load(rows, path, load)
    return path


def cross_source_diff(spark: SparkSession, d: str) -> DataFrame:
    """The table against a copy in which some costs are one higher and some rows are missing."""
    fact = _fact(spark, d)
    dearer = (F.col("total_costs") + F.when(F.col("row_hash").startswith("00"), 1).otherwise(0)).cast("decimal(14,2)")
    copy = fact.where(~F.col("row_hash").startswith("01")).withColumn("total_costs", dearer).withColumn("row_hash", row_hash(NAMES))
    return hashtree.difference(fact, copy, ["facility_name", "total_costs"])


def incremental_insert(spark: SparkSession, d: str) -> DataFrame:
    """All staged rows against a table that lacks one age group: only that group is new."""
    stored = _fact(spark, d).where(F.col("age_group") != "0 to 17")
    new = incremental.rows_to_insert(_stage(spark, d), stored, in_place=True)
    return new.select("row_hash", "discharge_year", "age_group", "total_charges", "source_rows")


def fill_absent_columns(spark: SparkSession, d: str) -> DataFrame:
    filled, absent = readers.fill_absent_columns(_stage(spark, d).drop("race", "payment_typology_3"), RAW_SCHEMA)
    return filled.select(
        "permanent_facility_id", "race", "payment_typology_3", "total_costs", F.lit(",".join(absent)).alias("absent")
    )


# ---- questions --------------------------------------------------------------------------------


def tag_metrics(spark: SparkSession, d: str) -> DataFrame:
    tags = Q.metrics_of(F.col("query"), LOCAL_METRICS)
    return fixtures.questions(spark, d).select("conv_id", "turn", F.array_join(tags, ",").alias("metrics"))


def intent_struct(spark: SparkSession, d: str) -> DataFrame:
    tagged = _tagged(spark, d).select("conv_id", "turn", "accepted", "intent.*")
    return tagged.withColumn("metrics", F.array_join("metrics", ","))


def answer_batch(spark: SparkSession, d: str) -> DataFrame:
    return answers.answer(_tagged(spark, d), _fact(spark, d), ["conv_id", "turn"])


def summary_text(spark: SparkSession, d: str) -> DataFrame:
    return answers.answer_summaries(_tagged(spark, d), _fact(spark, d), ["conv_id", "turn"])


# ---- cost model -------------------------------------------------------------------------------


def ml_sample(spark: SparkSession, d: str) -> DataFrame:
    return cost_model.train_test(_fact(spark, d), FIT_ROWS)[0].select("row_hash", "total_costs")


def ml_split(spark: SparkSession, d: str) -> DataFrame:
    return cost_model.split(_fact(spark, d)).select("row_hash", "is_train")


def ml_index(spark: SparkSession, d: str) -> DataFrame:
    return cost_model.category_index(cost_model.train_test(_fact(spark, d), FIT_ROWS)[0])


def ml_baseline(spark: SparkSession, d: str) -> DataFrame:
    return cost_model.median_baseline(*cost_model.train_test(_fact(spark, d), FIT_ROWS))


def ml_score_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every stored row has a score."""
    return ml_score(spark, d).select("row_hash", F.col("predicted_cost").isNotNull().alias("scored"))


def ml_sample_exact(spark: SparkSession, d: str) -> DataFrame:
    return cost_model.exact_sample(cost_model.train_rows(_fact(spark, d)), MODEL_ROWS).select("row_hash", "total_costs")


def ml_median_all(spark: SparkSession, d: str) -> DataFrame:
    return cost_model.exact_baseline(*cost_model.train_test_whole(_fact(spark, d)))


def ml_boost_scores(spark: SparkSession, d: str) -> DataFrame:
    """Predictions for all held-out rows by a model of all training rows."""
    train, test = cost_model.train_test_whole(_fact(spark, d))
    return boosting.score(boosting.fit(train), test).select("row_hash", "total_costs", "predicted_cents")


def ml_boost_metrics(spark: SparkSession, d: str) -> DataFrame:
    train, test = cost_model.train_test_whole(_fact(spark, d))
    return boosting.errors(boosting.score(boosting.fit(train), test))


def ml_cost_metrics(spark: SparkSession, d: str) -> DataFrame:
    _, metrics = cost_model.train_and_evaluate(_fact(spark, d), MODEL_ROWS)
    names = ["mae", "rmse", "r2", "baseline_mae", "train_rows", "test_rows"]
    return spark.range(1).select(*[F.lit(float(metrics[n])).alias(n) for n in names])


def ml_score(spark: SparkSession, d: str) -> DataFrame:
    train, _ = cost_model.train_test(_fact(spark, d), MODEL_ROWS)
    return cost_model.score(cost_model.fit(train), _fact(spark, d).select("row_hash", *cost_model.FEATURES))


# ---- registry ---------------------------------------------------------------------------------


def _on_fact(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: build(_fact(spark, d))


def _on_stage(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: build(_stage(spark, d))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "scan_csv": scan_csv,
        "scan_jsonl": scan_jsonl,
        "stream_ingest": stream_ingest,
        "project_canonical": project_canonical,
        "scan_csv_multiline": scan_csv_multiline,
        "stream_state_dedup": stream_state_dedup,
        "uncommitted_load": uncommitted_load,
        "ingest_strict": _on_stage(lambda df: cleaning.strict_table(df, in_place=True)),
        "bad_records": bad_records,
        "ledger_state": ledger_state,
        "ledger_latest": ledger_latest,
        "row_reconcile": row_reconcile,
        "reconcile_after_insert": reconcile_after_insert,
        "relaxed_identity": relaxed_identity,
        "stream_rejects": stream_rejects,
        "stream_ledger": stream_ledger,
        "dedup_full": _on_stage(lambda df: dedup.drop_duplicates(df, in_place=True)),
        "dedup_first": _dedup("first"),
        "dedup_last": _dedup("last"),
        "dedup_none": dedup_none,
        "clean_money": clean_money,
        "clean_birth_weight": clean_birth_weight,
        "clean_los_relaxed": clean_los_relaxed,
        "clean_types": clean_types,
        "clean_money_floor": clean_money_floor,
        "fill_missing": fill_missing,
        "clean_relaxed": _on_stage(lambda df: cleaning.clean_relaxed(df, in_place=True)),
        "clean_stats": _on_stage(cleaning.clean_stats),
        "clean_strict_text": _strict([c for c in TEXT_COLUMNS if c != "birth_weight"]),
        "clean_los_strict": _strict(["length_of_stay"]),
        "clean_strict_codes": _strict(["discharge_year", "apr_severity_of_illness_code"]),
        "clean_money_strict": _strict(["total_charges", "total_costs"]),
        **{f"q_{name}": _score(name) for name in quality.SCORES},
        "q_uniqueness": _on_stage(quality.uniqueness),
        "q_assess": _on_stage(lambda df: quality.assess(df, LAST_YEAR)),
        "q_accumulate": q_accumulate,
        "q_strict": _on_fact(lambda df: quality.strict_scores(df, LAST_YEAR)),
        "q_strict_overall": _on_fact(lambda df: quality.strict_report(df, LAST_YEAR)),
        "q_percent": _on_fact(lambda df: quality.percentages(quality.strict_report(df, LAST_YEAR))),
        "q_cells": q_cells,
        **{f"agg_{name}": _on_fact(lambda df, name=name: A.aggregate(df, name)) for name in A.DIMENSIONS},
        "agg_all_metrics": _on_fact(lambda df: A.aggregate(df, "service_area", list(A.METRICS))),
        "los_by_age": _on_fact(A.avg_length_of_stay_by),
        "cost_by_disease": _on_fact(A.cost_distribution),
        "payment_ratio": _on_fact(A.payment_ratio),
        "year_trend": _on_fact(A.year_trend),
        "trend_series": _on_fact(lambda df: overview.trend_series(A.year_trend(df))),
        "trend_available": _on_fact(A.trend_available),
        "overview_summary": _on_fact(A.summary),
        "overview_kpis": _on_fact(lambda df: overview.kpis(A.summary(df))),
        "overview_long": _on_fact(overview.overview),
        "dimension_values": _on_fact(lambda df: A.dimension_values(df, "mortality_risk")),
        "distinct_facilities": _on_fact(A.distinct_facilities),
        "filter_combo": _on_fact(
            lambda df: A.aggregate(df, "disease", ["count", "avg_total_costs"], filters=FILTERS)
        ),
        "top_hospitals": _on_fact(lambda df: A.aggregate(df, "hospital", ["count"], 10)),
        "share_of_shown": _on_fact(lambda df: overview.share_of_shown(A.aggregate(df, "disease", ["count"], 8))),
        "top_group": _on_fact(lambda df: overview.top_group(A.aggregate(df, "age_group", ["count"], 10))),
        "patient_segments": _on_fact(overview.segments),
        "disease_table": _on_fact(
            lambda df: overview.disease_table(
                A.aggregate(df, "disease", ["count", "avg_length_of_stay", "avg_total_charges"], 8)
            )
        ),
        "gender_share": _on_fact(lambda df: overview.gender_share(A.aggregate(df, "gender", ["count"], 10))),
        "payment_percent": _on_fact(lambda df: overview.payment_percent(A.payment_ratio(df))),
        "tag_dimension": _question_tag(lambda c: Q.dimension_of(c, LOCAL_DIMENSIONS), "dimension"),
        "tag_metrics": tag_metrics,
        "tag_chart": _question_tag(lambda c: Q.chart_of(c, LOCAL_CHARTS), "chart_type"),
        "extract_limit": _question_tag(Q.limit_of, "limit"),
        "extract_year": _question_tag(Q.year_of, "year"),
        "intent_struct": intent_struct,
        "question_rejects": lambda spark, d: Q.reject_counts(fixtures.questions(spark, d)),
        "answer_batch": answer_batch,
        "summary_text": summary_text,
        "report_markdown": _on_fact(answers.report),
        "report_empty_section": _on_fact(lambda df: answers.report(df.where("gender = 'none'"))),
        "route_rules": _question_tag(Q.route_of, "route"),
        "profile_columns": profile_columns,
        "profile_top_values": _on_fact(profile.top_values),
        "profile_heavy_hitters": _on_fact(sketches.heavy_hitters),
        "profile_sketches": profile_sketches,
        "cube_after_two_loads": lambda spark, d: cube.group_by(spark, _cube(spark, d)),
        "overview_cube": lambda spark, d: cube.overview(spark, _cube(spark, d)),
        "cross_source_diff": cross_source_diff,
        "dup_estimate": lambda spark, d: dedup.duplicate_rate(_hashed(spark, d).select("row_hash")),
        "anomaly_counts": _on_stage(lambda df: profile.count_rules(df, profile.anomaly_rules(LAST_YEAR))),
        "field_missing": _on_fact(profile.field_missing),
        "birth_weight_context": birth_weight_context,
        "facility_audit": lambda spark, d: profile.facility_audit({"raw": _stage(spark, d), "clean": _fact(spark, d)}),
        "cross_source_check": cross_source_check,
        "row_hash": _on_fact(lambda df: df.select("row_hash", "facility_name", "discharge_year", "source_rows")),
        "incremental_insert": incremental_insert,
        "fill_absent_columns": fill_absent_columns,
        "ml_sample": ml_sample,
        "ml_split": ml_split,
        "ml_index": ml_index,
        "ml_score_rows": ml_score_rows,
        "ml_baseline": ml_baseline,
        "ml_sample_exact": ml_sample_exact,
        "ml_median_all": ml_median_all,
        "ml_boost_scores": ml_boost_scores,
        "ml_boost_metrics": ml_boost_metrics,
        "ml_cost_metrics": ml_cost_metrics,
        "ml_score": ml_score,
    }
    q.update({f"bench_{name}": _on_fact(build) for name, build in BENCH.items()})
    return q


BENCH: dict[str, Callable[[DataFrame], DataFrame]] = {
    "overview": A.summary,
    "diseases_top": lambda df: A.aggregate(df, "disease", ["count"], 10),
    "diseases_cost": lambda df: A.cost_distribution(df, "disease", 10),
    "hospitals_top": lambda df: A.aggregate(df, "hospital", ["count"], 10),
    "hospitals_cost": lambda df: A.cost_distribution(df, "hospital", 10),
    "age_distribution": lambda df: A.aggregate(df, "age_group", ["count", "avg_length_of_stay"]),
    "age_cost": lambda df: A.cost_distribution(df, "age_group"),
    "payment_distribution": A.payment_ratio,
    "severity_distribution": lambda df: A.aggregate(df, "severity", ["count", "avg_length_of_stay"]),
    "yearly_trends": A.year_trend,
}
