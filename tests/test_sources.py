import json

import pytest
from conftest import line, record, rows_of, write_csv

from wardline.schema import FACT_SCHEMA, HEADERS, NAMES, RAW_SCHEMA
from wardline.sources import ledger, readers, store
from wardline.sources import multiline as split_lines


def test_csv_quirks(spark, tmp_path):
    odd = {"facility_name": 'St. "X", North', "ccsr_diagnosis_description": "two\nlines", "permanent_facility_id": "00012"}
    path = write_csv(tmp_path / "a.csv", [line(**odd), line(gender="")], bom=True)
    rows = readers.project_canonical(readers.read_source(spark, path, multiline=True)).orderBy("permanent_facility_id").collect()
    assert rows[1]["facility_name"] == 'St. "X", North' and rows[1]["ccsr_diagnosis_description"] == "two\nlines"
    assert rows[1]["permanent_facility_id"] == "00012" and rows[0]["gender"] is None


def test_short_rows_are_padded_and_long_ones_rejected(spark, tmp_path):
    short = ",".join(line().split(",")[:5])
    path = write_csv(tmp_path / "a.csv", [line(total_charges="7"), short, line(total_charges="8") + ",extra", line(facility_name="a,b", total_charges="9")])
    marked = readers.read_source(spark, path, keep_corrupt=True)
    assert readers.bad_record_counts(marked).first().asDict() == {"records": 4, "padded": 1, "rejected": 1}
    good, rejected = readers.split_rejects(marked)
    assert good.count() == 3 and rejected.first()["reason"] == "too many fields" and rejected.first()["record"].endswith(",extra")
    # The same rows come back when only a few columns are asked for.
    assert rows_of(readers.read_source(spark, path, drop_rejects=True).select("Total Charges")) == [("7",), ("9",), (None,)]
    with pytest.raises(Exception, match="too many fields"):
        readers.read_source(spark, path).collect()
    folder = str(tmp_path / "rejected")
    assert readers.quarantine_rejects(marked, "csv", folder, 1) == (4, 1)
    assert spark.read.parquet(folder).count() == 1
    with pytest.raises(ValueError, match="1 bad records"):
        readers.quarantine_rejects(marked, "csv", None, 0)


def test_line_break_in_quotes_is_a_reject_unless_asked_for(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [line(facility_name="two\nlines"), line()])
    marked = readers.read_source(spark, path, keep_corrupt=True)
    assert {r.reason for r in readers.split_rejects(marked)[1].collect()} == {"unbalanced quotes"}
    assert readers.read_source(spark, path, multiline=True).count() == 2


def test_very_long_quoted_field_of_a_bad_record(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [line(facility_name='x"y' * 350_000) + ",extra", line()])
    marked = readers.read_source(spark, path, keep_corrupt=True)
    assert readers.quarantine_rejects(marked, "csv", None, 1) == (2, 1)


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [line()] * 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert readers.read_source(spark, path).rdd.getNumPartitions() > 3
        assert readers.read_source(spark, path, multiline=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


ODD_CELLS = ["two\nlines", "\n", 'a "quoted\nword"', "x\n\n\ny", "plain", 'only "quotes"', ",\n,", "crlf\r\nhere"]


@pytest.mark.parametrize("size", [60, 700, 5000, 10**8])
def test_line_breaks_in_quotes_across_splits(spark, tmp_path, size):
    for name, shift in (("a", 0), ("b", 3)):
        rows = [line(facility_name=ODD_CELLS[(i + shift) % len(ODD_CELLS)], permanent_facility_id=f"{name}{i}") for i in range(40)]
        write_csv(tmp_path / f"{name}.csv", rows, bom=name == "a")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = readers.read_source(spark, str(tmp_path), "csv", multiline="split")
        found = {r["Permanent Facility Id"]: r["Facility Name"] for r in read.collect()}
        tasks = split_lines._lines(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = {f"{n}{i}": ODD_CELLS[(i + s) % len(ODD_CELLS)] for n, s in (("a", 0), ("b", 3)) for i in range(40)}
    assert {k: v.replace("\r\n", "\n") for k, v in found.items()} == {k: v.replace("\r\n", "\n") for k, v in expected.items()}
    assert tasks > 5 or size > 10**6


def test_split_reader_keeps_the_contract(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [line(), line(facility_name="two\nlines") + ",extra", ",".join(line().split(",")[:5]), line(facility_name='open "')[:-1] + '"'])
    marked = readers.read_source(spark, path, multiline="split", keep_corrupt=True)
    counts = readers.bad_record_counts(marked).first().asDict()
    assert counts["records"] == 4 and counts["padded"] == 1 and counts["rejected"] >= 1
    with pytest.raises(Exception, match="rejected record"):
        readers.read_source(spark, path, multiline="split").collect()
    write_csv(tmp_path / "b.csv", [line()], list(reversed(HEADERS)))
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_source(spark, str(tmp_path), "csv", multiline="split", drop_rejects=True).collect()
    assert readers.read_source(spark, write_csv(tmp_path / "d.csv", []), multiline="split").count() == 0


def test_unknown_json_key_and_repeated_header(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"Facility Name": "B", "Total Cost": 1}\n')
    with pytest.raises(Exception, match="unexpected: Total Cost"):
        readers.read_source(spark, str(tmp_path / "a.jsonl")).collect()
    with pytest.raises(ValueError, match="repeated: a"):
        readers.validate_columns(["a", "a"], ["a"])


def test_header_contract(spark, tmp_path):
    reordered = list(reversed(HEADERS))
    fields = [str(record()[n] or "").replace(",", "") for n in reversed(NAMES)]
    path = write_csv(tmp_path / "ok.csv", [",".join(fields)], reordered)
    assert readers.project_canonical(readers.read_source(spark, path)).first()["facility_name"] == "A"
    wrong = write_csv(tmp_path / "bad.csv", [line()], [*HEADERS[:-1], "Total Cost"])
    with pytest.raises(ValueError, match="Total Costs.*Total Cost"):
        readers.read_source(spark, wrong)


def test_folder_with_another_header_order_fails(spark, tmp_path):
    write_csv(tmp_path / "1.csv", [line()])
    write_csv(tmp_path / "2.csv", [line()], list(reversed(HEADERS)))
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_source(spark, str(tmp_path), "csv").collect()


def test_tsv_and_json_lines(spark, tmp_path):
    text = "\t".join(HEADERS) + "\n" + "\t".join(str(record()[n] or "") for n in NAMES) + "\n"
    (tmp_path / "a.tsv").write_text(text)
    assert readers.read_source(spark, str(tmp_path / "a.tsv")).first()["Total Charges"] == "1,200.50"
    lines = [json.dumps({h: record()[n] for h, n in zip(HEADERS, NAMES)}), '{"Facility Name": "B", "Zip Code - 3 digits": 12}', "{broken"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows = readers.project_canonical(readers.read_source(spark, str(tmp_path / "a.jsonl"), drop_rejects=True)).orderBy("facility_name").collect()
    assert [r["permanent_facility_id"] for r in rows] == ["0001", None] and rows[1]["zip_code_3"] == "12"


def test_unknown_format_and_missing_file(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_source(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(FileNotFoundError):
        readers.read_source(spark, str(tmp_path / "none.csv"))


def test_absent_columns_are_filled_and_listed(raw):
    filled, absent = readers.fill_absent_columns(raw({}).drop("race"), RAW_SCHEMA)
    assert absent == ["race"] and filled.columns == NAMES and filled.first()["race"] is None
    with pytest.raises(ValueError):
        readers.project_canonical(raw({}).drop("race"))


def test_create_tables_twice(spark, tmp_path):
    for _ in range(2):
        names = store.create_tables(spark, "t_", str(tmp_path))
    assert spark.table(names[0]).schema.fieldNames() and set(spark.table(names[0]).columns) == set(FACT_SCHEMA.names)
    assert spark.table(names[2]).count() == 0
    for name in names:
        spark.sql(f"drop table {name}")


def test_ledger_states(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for run in (1, 2):
        ledger.append_event(spark, path, run_id=run, event_seq=0, status="running", started_at=ledger.now())
    ledger.append_event(spark, path, run_id=1, event_seq=2, status="completed", rows_read=5, quality={"overall": 0.5, "sample_size": 5})
    ledger.append_event(spark, path, run_id=2, event_seq=2, status="failed", error="x" * 3000)
    state = {r["run_id"]: r for r in ledger.latest_per_run(ledger.read_ledger(spark, path)).collect()}
    assert state[1]["status"] == "completed" and state[1]["rows_read"] == 5
    latest = ledger.latest_run(ledger.read_ledger(spark, path)).first()
    assert latest["run_id"] == 2 and len(latest["error_message"]) == 2000 and latest["quality"] is None
    with pytest.raises(ValueError):
        ledger.append_event(spark, path, run_id=3, status="odd")


def test_exported_text_is_compressed(spark):
    """The text of a large table is some ten times its size."""
    import os

    from conftest import SF

    from wardline.plans import tables

    for folder in (tables.csv_folder(spark, SF), tables.json_folder(spark, SF)):
        files = [f for f in os.listdir(folder) if f.startswith("part-")]
        assert files and all(f.endswith(".gz") for f in files)
