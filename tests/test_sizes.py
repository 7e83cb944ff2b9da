"""What grows with the input: the plans and files behind the shuffled and written megabytes."""

import glob
from contextlib import contextmanager

from conftest import SF, line, write_csv
from pyspark.sql import functions as F

from wardline import fixtures
from wardline.schema import FACT_SCHEMA
from wardline.sources import store


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_meet_parts_before_the_names_of_small_tables(spark):
    """Where parts are too many for a broadcast, the rows shuffled for them hold no facility or county names."""
    lines = _plan(fixtures.discharge_raw(spark, SF)).splitlines()
    parts = next(i for i, line in enumerate(lines) if "Join" in line and "p_partkey" in line)
    facilities = next(i for i, line in enumerate(lines) if "Join" in line and "s_suppkey" in line)
    assert facilities < parts  # the upper join of the tree comes first in the text


@contextmanager
def unset_broadcast(spark):
    """Only joins that are marked for it are broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _facts(spark, hashes):
    given = {"row_hash": F.col("row_hash"), "discharge_year": F.lit(2001)}
    columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA]
    return spark.createDataFrame([(h,) for h in hashes], "row_hash string").select(*columns)


def test_stored_rows_are_compressed_and_identities_travel_as_bytes(spark, tmp_path):
    path = str(tmp_path / "fact")
    assert store.write_fact(_facts(spark, ["0a" * 32, "0b" * 32]), path) == 2
    assert all(".zstd." in f for f in glob.glob(f"{path}/*/*.parquet"))
    stored, new = store.read_fact(spark, path), _facts(spark, ["0b" * 32, "0c" * 32, None])
    for ways in ({}, {"as_bytes": True}, {"few": True}):
        absent = store.absent_rows(new, stored, [2001], **ways)
        assert sorted(absent.select("row_hash").collect(), key=str) == [("0c" * 32,), (None,)]
        assert sorted(absent.columns) == sorted(new.columns)
        assert ("unhex" in _plan(absent)) == ("as_bytes" in ways)


def test_few_new_rows_leave_the_stored_ones_where_they_are(spark, tmp_path):
    """Of the stored identities only those of the new rows are shuffled."""
    path = str(tmp_path / "fact")
    many = [format(i, "064x") for i in range(2000)]
    store.write_fact(_facts(spark, many), path)
    absent = store.absent_rows(_facts(spark, [many[7], "f" * 64]), store.read_fact(spark, path), [2001], few=True)
    with unset_broadcast(spark):
        assert [r["row_hash"] for r in absent.select("row_hash").collect()] == ["f" * 64]
        dealt = [line for line in absent._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert any("LeftSemi" in line for line in dealt)


def test_a_batch_of_one_file_is_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    from wardline.streaming import ingest as stream

    folder = tmp_path / "in"
    folder.mkdir()
    write_csv(folder / "a.csv", [line(length_of_stay=str(n)) for n in range(100)])
    seen, plain = [], stream.rows_to_insert

    def counted(raw, *rest, **more):
        seen.append(raw.select(F.spark_partition_id()).distinct().count())
        return plain(raw, *rest, **more)

    monkeypatch.setattr(stream, "rows_to_insert", counted)
    assert stream.ingest_stream(spark, str(folder), str(tmp_path / "out"), last_year=2026).count() == 100
    assert seen and seen[0] > 1


def test_a_batch_is_scored_while_it_is_inserted(spark, tmp_path, monkeypatch):
    import threading

    from wardline.streaming import ingest as stream

    folder = tmp_path / "in"
    folder.mkdir()
    write_csv(folder / "a.csv", [line(length_of_stay=str(n)) for n in range(5)])
    both = threading.Barrier(2, timeout=60)

    def meeting(plain):
        def run(*given, **more):
            both.wait()
            return plain(*given, **more)

        return run

    monkeypatch.setattr(stream, "rows_to_insert", meeting(stream.rows_to_insert))
    monkeypatch.setattr(stream.quality, "quality_sums", meeting(stream.quality.quality_sums))
    assert stream.ingest_stream(spark, str(folder), str(tmp_path / "out"), last_year=2026).count() == 5


def test_missing_texts_are_all_found_and_odd_names_kept(spark):
    from wardline.functions.text import MISSING_TOKENS
    from wardline.operators import cleaning

    rows = [(t, "kept") for t in [*MISSING_TOKENS, None, " NA", "it's"]]
    found = cleaning.missing_tokens(spark.createDataFrame(rows, "`a ``b` string, `c-d` string"))
    assert found.columns == ["a `b", "c-d"]
    assert [r[0] for r in found.collect() if r[0] is not None] == [" NA", "it's"]
