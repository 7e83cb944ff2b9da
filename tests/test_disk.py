"""What large tables leave on disk: whole rows are not shuffled for their copies, finished writes keep no shuffle files."""

import os

import pytest
from pyspark.sql import functions as F

from wardline.operators import cleaning, dedup
from wardline.plans import registry
from wardline.session import FREED
from wardline.sources import store
from tests.conftest import SF


def _below(plan: str, operator: str) -> list[tuple[str, str]]:
    """(line, operators below it) for an operator of a plan's text, which shows depth by indentation."""
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if operator in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append((line, "\n".join(lines[i + 1 : end])))
    return out


@pytest.mark.parametrize("name", ["ingest_strict", "dedup_full", "clean_relaxed"])
def test_only_rows_that_may_have_copies_are_shuffled_whole(spark, name):
    found = registry.queries()[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    wide = [below for line, below in _below(plan, "Exchange hashpartitioning") if line.split("hashpartitioning(")[1].count("#") > 20]
    assert wide and all("_bits" in below for below in wide)


def test_copies_in_place_are_the_plain_ones(raw):
    rows = raw({}, {}, {"gender": None}, {"gender": None}, {"gender": "M"}, {"total_costs": "7"}, {"discharge_year": None})
    whole = lambda df: sorted(map(str, df.collect()))
    assert whole(dedup.drop_duplicates(rows, in_place=True)) == whole(dedup.drop_duplicates(rows))
    assert dedup.drop_duplicates(rows, in_place=True).columns == rows.columns
    assert whole(cleaning.clean_relaxed(rows, in_place=True)) == whole(cleaning.clean_relaxed(rows))
    assert dedup.drop_duplicates(rows, in_place=True).count() == 5


def _shuffle_files(spark) -> set[str]:
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_a_finished_write_keeps_no_shuffle_files(spark, tmp_path, raw):
    before = _shuffle_files(spark)
    rows = store.to_fact(cleaning.strict_table(raw(*({"total_costs": str(i % 50)} for i in range(200)))))
    assert store.write_fact(rows, str(tmp_path / "fact")) == 50
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(next(iter(FREED)), None) is None
    rows.agg(F.count("*")).collect()
    assert _shuffle_files(spark) - before  # a read keeps its own


def test_an_insert_folds_copies_in_place(spark):
    """What meets the stored identities are the returned columns, not whole rows grouped before."""
    plan = registry.queries()["incremental_insert"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bits" in plan and "Union" in plan


def test_a_load_meets_the_held_ones_without_whole_rows(spark, tmp_path):
    """Of the rows of a load only those that may be held are shuffled; the same rows are left as before."""
    from wardline.schema import FACT_SCHEMA
    from wardline.sources import commits

    def facts(hashes):
        given = {"row_hash": F.col("row_hash"), "discharge_year": F.lit(2001), "source_rows": F.lit(1)}
        columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA]
        return spark.createDataFrame([(h,) for h in hashes], "row_hash string").select(*columns)

    target, many = str(tmp_path / "loads"), [format(i, "064x") for i in range(300)]
    commits.load(spark, target, "a", facts(many))
    left = commits.absent(facts([*many[:9], "f" * 64, "f" * 64, None]), target)
    assert sorted(left.select("row_hash").collect(), key=str) == [("f" * 64,), ("f" * 64,), (None,)]
    assert all("_bits" in below for _, below in _below(left._jdf.queryExecution().executedPlan().toString(), "LeftAnti"))


def test_a_stream_keeps_identities_as_bytes_and_few_versions(spark, tmp_path):
    from conftest import line, write_csv

    from wardline.streaming import state

    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for i in range(4):
        write_csv(folder / f"{i}.csv", [line(total_costs=str(i)), line(total_costs="7")])
    before = {k: spark.conf.get(k, None) for k in state.SETTINGS}
    table = state.ingest_state(spark, str(folder), target, max_files=1)
    assert table.count() == 5 and table.where("row_hash rlike '^[0-9a-f]{64}$'").count() == 5
    assert {k: spark.conf.get(k, None) for k in state.SETTINGS} == before
    names = [f for _, _, files in os.walk(f"{target}/checkpoint/state") for f in files]
    assert any(f.endswith(".changelog") for f in names)
    assert all(".zstd." in f for _, _, files in os.walk(f"{target}/fact") for f in files if f.startswith("part-"))


def test_rejected_text_is_compressed(spark):
    folder = registry._with_long_rows(spark, SF)
    assert all(f.endswith(".gz") for f in os.listdir(folder) if f.startswith("part-"))
