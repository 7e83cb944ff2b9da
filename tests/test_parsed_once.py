"""Text records are parsed once, however many columns and tests name their cells."""

from __future__ import annotations

from wardline.schema import HEADERS, NAMES
from wardline.sources import readers


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_records_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"Facility Name": "x", "Total Costs": "1.50"}\n\n{"Gender": "F"}\n')
    rows = readers.project_canonical(readers.read_source(spark, str(tmp_path), "json"))
    assert _plan(rows).count("from_json(") == 1
    assert sorted(rows.select("facility_name", "gender", "total_costs").collect(), key=str) == [("x", None, "1.50"), (None, "F", None)]


def test_split_records_are_parsed_once(spark, tmp_path):
    cells = [f"v{i}" for i in range(len(HEADERS))]
    text = ",".join(HEADERS) + "\n" + ",".join(cells) + "\n" + ",".join(['"a\nb"', *cells[1:]]) + "\n"
    (tmp_path / "a.csv").write_text(text)
    rows = readers.project_canonical(readers.read_source(spark, str(tmp_path), "csv", multiline=readers.SPLIT))
    assert _plan(rows).count("from_csv(") == 1
    assert sorted(rows.select(NAMES[0], NAMES[-1]).collect()) == [("a\nb", cells[-1]), ("v0", cells[-1])]
