"""Loads that come piece by piece: keyed state in streams, commits, aggregates kept up to date."""

import pytest
from conftest import SF, line, rows_of, write_csv
from pyspark.sql import functions as F

from wardline.operators import aggregate as A
from wardline.operators.overview import overview
from wardline.plans import cube, tables
from wardline.plans.registry import _loads
from wardline.sources import commits, ledger, store
from wardline.streaming import state


def files(folder, *batches):
    folder.mkdir(exist_ok=True)
    for name, lines in batches:
        write_csv(folder / f"{name}.csv", lines)
    return str(folder)


def events(spark, target):
    return ledger.read_ledger(spark, f"{target}/ledger").orderBy("run_id", "event_seq").collect()


def test_state_finds_copies_across_batches_and_calls(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    files(source, ("a", [line(), line(facility_name="B")]), ("b", [line(), line(facility_name=" B "), line(facility_name="C")]))
    table = state.ingest_state(spark, str(source), target, max_files=1, run_id=1)
    assert sorted(r.facility_name for r in table.collect()) == ["A", "B", "C"]
    files(source, ("c", [line(), line(facility_name="D")]))
    table = state.ingest_state(spark, str(source), target, max_files=1, run_id=2)
    assert sorted(r.facility_name for r in table.collect()) == ["A", "B", "C", "D"]
    last = [e for e in events(spark, target) if e.status == "completed"]
    assert [(e.run_id, e.rows_read, e.rows_inserted, e.rows_dropped, e.rows_rejected, e.chunks_processed) for e in last] == [(1, 5, 3, 2, 0, 2), (2, 2, 1, 1, 0, 1)]
    assert [e.status for e in events(spark, target) if e.run_id == 1] == ["running", "running", "running", "completed"]


def test_later_batches_read_nothing_that_is_stored(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    files(source, *((f"f{i}", [line(facility_name=f"F{i}"), line()]) for i in range(10)))
    with state._settings(spark):
        rows = store.to_fact(state.distinct_stream(state._counted(state.read_stream(spark, str(source), "csv", 1), "csv")).withColumn("source_rows", F.lit(1).cast("long")))
        query = rows.writeStream.format("parquet").option("path", f"{target}/fact").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p.numInputRows]
    assert len(progress) == 10 and len(progress[-1].sources) == 1
    # the last batch puts in one identity and reads its own two rows; the ten earlier ones are looked up by key
    last = progress[-1]
    assert last.numInputRows == 2 and last.stateOperators[0].numRowsUpdated == 1 and last.stateOperators[0].numRowsTotal == 11
    assert target not in query._jsq.lastProgress().sources()[0].description()
    assert store.read_fact(spark, f"{target}/fact").count() == 11


def test_state_counts_and_keeps_rejects(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    files(source, ("a", [line(), line() + ",x"]))
    table = state.ingest_state(spark, str(source), target, run_id=1)
    assert table.count() == 1
    done = events(spark, target)[-1]
    assert (done.status, done.rows_read, done.rows_rejected) == ("completed", 1, 1)
    assert [r.reason for r in spark.read.parquet(f"{target}/rejected").collect()] == ["too many fields"]
    with pytest.raises(ValueError, match="1 bad records, at most 0"):
        state.ingest_state(spark, files(tmp_path / "other", ("a", [line() + ",x"])), str(tmp_path / "strict"), most_rejects=0)
    assert events(spark, str(tmp_path / "strict"))[-1].status == "failed"


def test_state_of_an_empty_table(spark, tmp_path):
    table = state.ingest_state(spark, files(tmp_path / "in", ("a", [])), str(tmp_path / "out"))
    assert table.count() == 0


def test_a_load_without_commit_is_invisible(spark, fact, tmp_path):
    target = str(tmp_path / "loads")
    rows = fact.orderBy("row_hash").limit(30)
    rejects = spark.createDataFrame([("x,y", "too many fields")], "record string, reason string")

    def stop():
        raise InterruptedError("no commit")

    with pytest.raises(InterruptedError):
        commits.load(spark, target, "one", rows, rejects, before_commit=stop)
    assert commits.read_loads(spark, target).count() == 0 and commits.read_rejects(spark, target).count() == 0
    assert commits.read_commits(spark, target).count() == 0
    assert commits.absent(rows, target).count() == 30
    told = commits.load(spark, target, "one", rows.limit(20), rejects, rows_read=25)
    assert (told["rows_read"], told["rows_inserted"], told["rows_rejected"]) == (25, 20, 1)
    assert commits.read_loads(spark, target).count() == 20  # nothing of the broken try is left
    assert commits.read_rejects(spark, target).count() == 1
    with pytest.raises(ValueError, match="committed already"):
        commits.load(spark, target, "one", rows)
    assert commits.load(spark, target, "two", commits.absent(rows, target))["rows_inserted"] == 10
    assert commits.read_commits(spark, target).agg(F.sum("rows_inserted")).first()[0] == commits.read_loads(spark, target).count() == 30


def test_cube_keeps_up(spark, fact, tmp_path):
    path = str(tmp_path / "cube")
    parts = _loads(fact)
    cube.add_load(parts["first"], path, "first")
    cube.add_load(parts["second"], path, "second")
    cube.add_load(parts["second"], path, "second")  # again: replaced, not added
    assert rows_of(cube.overview(spark, path)) == rows_of(overview(fact))
    one = cube.group_by(spark, path, years=[1997]).where("dimension = 'gender'").select("dimension_value", "count", "avg_total_costs")
    assert rows_of(one) == rows_of(A.aggregate(fact, "gender", ["count", "avg_total_costs"], None, {"year": 1997}))


def test_cube_reads_no_fact(spark, tmp_path):
    path = str(tmp_path / "cube")
    cube.add_load(tables.fact(spark, SF), path, "all")
    assert {f.split("/load=")[0].removeprefix("file://") for f in cube.overview(spark, path).inputFiles()} == {path}
