"""The stored table is written without sorting whole rows by year."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from wardline.schema import FACT_SCHEMA
from wardline.sources import store

SETTING = "spark.sql.maxConcurrentOutputFileWriters"
SPLITS = "spark.sql.files.maxPartitionBytes"


def _facts(spark, years):
    """Three rows of every year, in four tasks that each hold rows of many years."""
    given = {"row_hash": F.format_string("%064x", F.col("n")), "discharge_year": F.col("year"), "source_rows": F.lit(1)}
    columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA]
    rows = [(i, y) for i, y in enumerate(list(years) * 3)]
    return spark.createDataFrame(rows, "n int, year int").repartition(4).select(*columns)


@pytest.fixture
def sorted_at_write(spark, tmp_path, monkeypatch):
    """Whether a table written by year would be sorted for it, asked whenever files are written."""
    spark.sql(f"create table side_by_side (v int, y int) using parquet partitioned by (y) location '{tmp_path}/asked'")
    seen, plain = [], DataFrameWriter.parquet

    def looked(self, *args, **more):
        plan = spark.sql("explain insert into side_by_side select id, id from range(3)").first()[0]
        assert "InsertIntoHadoopFsRelation" in plan
        seen.append("Sort" in plan)
        return plain(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", looked)
    yield seen
    spark.sql("drop table side_by_side")


@pytest.mark.parametrize("rebalance", [True, False])
def test_rows_are_not_sorted_by_year(spark, tmp_path, sorted_at_write, rebalance):
    assert store.write_fact(_facts(spark, range(1990, 1998)), str(tmp_path / "fact"), rebalance=rebalance) == 24
    assert sorted_at_write == [False]
    assert spark.conf.get(SETTING, None) is None


def test_more_years_than_open_files_and_missing_ones_are_all_written(spark, tmp_path):
    years = [*range(1900, 1900 + 2 * store.OPEN_FILES), None]
    path = str(tmp_path / "fact")
    assert store.write_fact(_facts(spark, years), path, rebalance=False) == 3 * len(years)
    held = store.read_fact(spark, path).groupBy("discharge_year").agg(F.countDistinct("row_hash").alias("n")).collect()
    assert sorted(map(tuple, held), key=str) == sorted(((y, 3) for y in years), key=str)


def test_the_session_keeps_its_own_number(spark, tmp_path):
    spark.conf.set(SETTING, 0)
    try:
        with store.unless_set(spark, store.SIDE_BY_SIDE):
            assert spark.conf.get(SETTING) == "0"
        assert spark.conf.get(SETTING, None) == "0"
    finally:
        spark.conf.unset(SETTING)
    with pytest.raises(ZeroDivisionError), store.unless_set(spark, store.SIDE_BY_SIDE):
        1 / 0
    assert spark.conf.get(SETTING, None) is None


def test_copies_are_found_in_small_tasks(spark, tmp_path, monkeypatch):
    seen, plain = [], DataFrameWriter.parquet

    def looked(self, *args, **more):
        seen.append(spark.conf.get(SPLITS, None))
        return plain(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", looked)
    for rebalance in (False, True):
        store.write_fact(_facts(spark, [2001]), str(tmp_path / str(rebalance)), rebalance=rebalance)
    assert seen == ["32m", None]
    assert spark.conf.get(SPLITS, None) is None
