import os

import pytest
from conftest import line, rows_of, write_csv

from wardline.plans import incremental
from wardline.plans.ingest import cleaned_table, ingest, reconcile, years_in
from wardline.sources import ledger, store
from wardline.streaming import ingest as stream

LINES = [line(), line(), line(facility_name=" A "), line(facility_name="B", total_charges="-1"), line(discharge_year="2020")]


@pytest.fixture()
def source(tmp_path):
    return write_csv(tmp_path / "in.csv", LINES)


def fact(spark, path):
    return store.read_fact(spark, path)


def test_strict_load_and_guard(spark, source, tmp_path):
    target, book = str(tmp_path / "fact"), str(tmp_path / "ledger")
    out = ingest(spark, source, target, book, last_year=2026, run_id=7)
    assert (out["rows_read"], out["rows_inserted"], out["rows_dropped"], out["reconciled"]) == (5, 3, 2, True)
    assert out["quality"]["uniqueness"] == 0.6 and out["quality"]["sample_size"] == 5
    state = ledger.latest_run(ledger.read_ledger(spark, book)).first()
    assert (state["run_id"], state["status"], state["rows_read"]) == (7, "completed", 5)
    assert state["quality"]["overall"] == out["quality"]["overall"]
    with pytest.raises(ValueError, match="already holds 3 rows"):
        ingest(spark, source, target)
    again = ingest(spark, source, target, truncate=True)
    assert again["rows_inserted"] == 3 and fact(spark, target).count() == 3
    store.truncate(spark, target)
    assert fact(spark, target).isEmpty()


def test_relaxed_load(spark, source, tmp_path):
    out = ingest(spark, source, str(tmp_path / "fact"), profile="relaxed", last_year=2026)
    # " A " and "A" differ as raw text, so only the exact copy goes.
    assert (out["rows_read"], out["rows_inserted"], out["rows_dropped"]) == (5, 4, 1)
    charges = {r["facility_name"]: r["total_charges"] for r in fact(spark, str(tmp_path / "fact")).collect()}
    assert charges["B"] == 0


def test_dry_run_writes_nothing(spark, source, tmp_path):
    out = ingest(spark, source, str(tmp_path / "fact"), dry_run=True)
    assert out["dry_run"] and out["rows_inserted"] == 3 and not (tmp_path / "fact").exists()
    bad = write_csv(tmp_path / "bad.csv", [line(), *[line() + ",x"] * 500])
    with pytest.raises(ValueError, match="500 bad records"):
        ingest(spark, bad, str(tmp_path / "fact"), dry_run=True)
    out = ingest(spark, bad, str(tmp_path / "fact"), dry_run=True, most_rejects=500)
    assert (out["rows_read"], out["rows_inserted"], out["rows_rejected"]) == (1, 1, 500)


def test_rejects_are_kept_and_counted(spark, tmp_path):
    bad, target, book = write_csv(tmp_path / "bad.csv", [line(), line() + ",x"]), str(tmp_path / "fact"), str(tmp_path / "ledger")
    out = ingest(spark, bad, target, book)
    assert (out["rows_read"], out["rows_inserted"], out["rows_rejected"]) == (1, 1, 1)
    assert spark.read.parquet(f"{target}_rejected").first()["record"].endswith(",x")
    state = ledger.latest_run(ledger.read_ledger(spark, book)).first()
    assert state["rows_rejected"] == 1 and state["source_size_bytes"] == (tmp_path / "bad.csv").stat().st_size


def test_counters_after_inserts(spark, raw, tmp_path):
    target = str(tmp_path / "fact")
    for _ in range(2):
        incremental.insert_new(spark, raw({}, {}, {}), target)
    state = lambda: reconcile(fact(spark, target), store.read_loads(spark, target)).first().asDict()
    assert state() == {"rows_read": 6, "rows_inserted": 1, "rows_dropped": 5, "reconciled": True}
    # A row that no load accounts for.
    store.write_fact(store.to_fact(cleaned_table(raw({"gender": "M"}))), target)
    assert not state()["reconciled"]


def test_relaxed_identity_is_unique_and_stream_equals_batch(spark, tmp_path):
    lines = [line(total_charges="1,200"), line(total_charges="1200"), line()]
    folder, target = tmp_path / "in", str(tmp_path / "fact")
    folder.mkdir()
    source = write_csv(folder / "a.csv", lines)
    out = ingest(spark, source, target, profile="relaxed", last_year=2026)
    assert (out["rows_read"], out["rows_inserted"], out["reconciled"]) == (3, 2, True)
    table = stream.ingest_stream(spark, str(folder), str(tmp_path / "out"), profile="relaxed", last_year=2026)
    assert hashes(table) == hashes(fact(spark, target))


def test_no_staging_folder_is_left(spark, source, tmp_path):
    from wardline.session import shared_root

    before = {p for p in os.listdir(shared_root(spark)) if p.startswith("stage-")}
    ingest(spark, source, str(tmp_path / "fact"))
    assert {p for p in os.listdir(shared_root(spark)) if p.startswith("stage-")} == before


def test_fact_write_has_one_full_exchange(raw):
    plan = store.to_fact(cleaned_table(raw({}, {"gender": "M"})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_failed_load_is_recorded(spark, tmp_path):
    bad = write_csv(tmp_path / "bad.csv", [line() + ",x"] * 3)
    with pytest.raises(ValueError, match="3 bad records"):
        ingest(spark, bad, str(tmp_path / "fact"), str(tmp_path / "ledger"), most_rejects=2)
    state = ledger.latest_run(ledger.read_ledger(spark, str(tmp_path / "ledger"))).first()
    assert state["status"] == "failed" and "3 bad records" in state["error_message"]


def test_second_insert_adds_nothing(spark, raw, tmp_path):
    target = str(tmp_path / "fact")
    frame = raw({}, {}, {"discharge_year": None}, {"discharge_year": "2019"})
    assert incremental.insert_new(spark, frame, target) == 3
    assert incremental.insert_new(spark, frame, target) == 0
    assert incremental.insert_new(spark, frame.union(raw({"facility_name": "New"})), target) == 1
    assert fact(spark, target).count() == 4


def test_insert_reads_only_the_years_that_occur(spark, raw, tmp_path):
    target = str(tmp_path / "fact")
    incremental.insert_new(spark, raw({}, {"discharge_year": "2019"}), target)
    new = incremental.rows_to_insert(raw({"gender": "M"}), fact(spark, target))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2021" in plan.split("PartitionFilters")[-1]


def test_bucketed_store_is_not_shuffled(spark, raw, tmp_path):
    table = store.to_fact(cleaned_table(raw({}, {"gender": "M"})))
    store.write_bucketed(table, "bucketed_fact", 4, str(tmp_path / "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = spark.table("bucketed_fact")
        joined = table.join(stored.select("row_hash"), "row_hash", "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(row_hash") == 1
        assert joined.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_fact")


# ---- stream -----------------------------------------------------------------------------------


def hashes(df):
    return sorted(r[0] for r in df.select("row_hash").collect())


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write_csv(folder / "1.csv", LINES[:3])
    write_csv(folder / "2.csv", LINES[2:])
    table = stream.ingest_stream(spark, str(folder), target, max_files=1, last_year=2026)
    whole = write_csv(tmp_path / "whole.csv", LINES[:3] + LINES[2:])
    ingest(spark, whole, str(tmp_path / "fact"), last_year=2026)
    assert hashes(table) == hashes(fact(spark, str(tmp_path / "fact")))
    before = rows_of(table.select("row_hash", "batch_id"))

    # A later file with one old and one new row.
    write_csv(folder / "3.csv", [LINES[0], line(facility_name="C")])
    table = stream.ingest_stream(spark, str(folder), target, max_files=1, last_year=2026)
    assert table.count() == len(before) + 1
    state = ledger.latest_run(stream.read_stream_ledger(spark, target)).first()
    assert (state["rows_read"], state["rows_inserted"], state["chunks_processed"]) == (8, 4, 3)

    # Replaying the last batch by hand leaves table, scores and ledger as they are.
    marked = spark.read.options(**stream.readers.csv_options("csv")).schema(
        stream.readers.text_schema(stream.readers.HEADERS, corrupt=True)
    ).csv(str(folder / "3.csv"))
    stream.process_batch(marked, 2, target, last_year=2026)
    assert stream.read_stream_fact(spark, target).count() == 4
    assert stream.total_quality(spark, target).first()["sample_size"] == 8


def test_stream_cap_stops_between_batches(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for i in range(3):
        write_csv(folder / f"{i}.csv", [line(facility_name=str(i))])
    assert stream.ingest_stream(spark, str(folder), target, max_files=1, max_batches=1, last_year=2026).count() == 1
    assert stream.ingest_stream(spark, str(folder), target, max_files=1, last_year=2026).count() == 3


def test_stream_of_json_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"Facility Name": "A", "Discharge Year": "2021"}\n{bad\n')
    table = stream.ingest_stream(spark, str(folder), str(tmp_path / "out"), fmt="json", last_year=2026)
    assert ledger.latest_run(stream.read_stream_ledger(spark, str(tmp_path / "out"))).first()["rows_rejected"] == 1
    assert rows_of(table.select("facility_name", "discharge_year")) == [("A", 2021)]


def test_stream_refuses_a_wrong_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        stream.ingest_stream(spark, str(tmp_path), str(tmp_path / "out"))


def test_failing_stream_is_recorded(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write_csv(folder / "1.csv", [line()])
    stream.ingest_stream(spark, str(folder), target, last_year=2026, run_id=1)
    write_csv(folder / "2.csv", [line(), *[line() + ",x"] * 3])
    with pytest.raises(Exception, match="3 bad records"):
        stream.ingest_stream(spark, str(folder), target, last_year=2026, most_rejects=2, run_id=2)
    runs = {r.run_id: r for r in ledger.latest_per_run(stream.read_stream_ledger(spark, target)).collect()}
    assert runs[1].status == "completed" and runs[1].finished_at >= runs[1].started_at and runs[1].source_size_bytes > 0
    assert runs[2].status == "failed" and "3 bad records" in runs[2].error_message and runs[2].rows_read == 1
    assert spark.read.parquet(f"{target}/rejected").count() == 3


def test_folder_of_files_with_a_given_format(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        write_csv(tmp_path / "in" / f"{i}.csv", [line(), line(facility_name=str(i))])
    out = ingest(spark, str(tmp_path / "in"), str(tmp_path / "fact"), fmt="csv")
    assert (out["rows_read"], out["rows_inserted"]) == (4, 3)


def test_years_follow_the_profile(raw):
    frame = raw({"discharge_year": "2021"}, {"discharge_year": "2020.0"}, {"discharge_year": None})
    assert sorted(years_in(frame), key=str) == [2021, None]
    assert sorted(years_in(frame, "relaxed"), key=str) == [2020, 2021, None]


def test_rejects_are_written_by_every_partition(spark, monkeypatch):
    from compare import connect, difference
    from conftest import SF

    from wardline.plans import oracle, registry

    staged = registry._stage(spark, SF).repartition(4).cache()
    monkeypatch.setattr(registry, "_stage", lambda *_: staged)
    lines = spark.read.text(registry._with_long_rows(spark, SF)).select("value", "_metadata.file_path").collect()
    headers = [r for r in lines if r.value.startswith('"Hospital Service Area"')]
    assert len({r.file_path for r in lines}) == len(headers) == 4 and len(lines) == staged.count() + 4
    assert difference(registry.stream_rejects(spark, SF), connect(SF), oracle.oracle_sql()["stream_rejects"]) is None
    staged.unpersist()
