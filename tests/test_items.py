"""The raw rows from items whose days and tax rates were made coarser before the shuffle."""

import datetime as dt

from pyspark.sql import functions as F

from wardline import fixtures
from wardline.schema import NAMES

DAYS = [None, dt.datetime(1995, 1, 1), dt.datetime(1996, 12, 31, 23, 59, 59, 999999), dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31)]
RATES = [None, 0.0, -1.0, 0.05, 0.049999999999999996, 0.050000000000000003, 0.08, float("nan"), float("inf"), float("-inf")]


def _tables(spark, folder):
    items = [(106 + i, 1, 1, i % 8, float(i % 51), 900.0 + i * 7.77, tax, "ANR"[i % 3], "FO"[i % 2], day)
             for i, (day, tax) in enumerate((d, t) for d in DAYS for t in RATES)]
    given = {
        "lineitem": (items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(x[0], 1, "FOP"[x[0] % 3], "1-URGENT") for x in items], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "customer": ([(1, "BUILDING", 3)], "c_custkey long, c_mktsegment string, c_nationkey int"),
        "supplier": ([(1, "S", 3)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(3, "N", 2)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(2, "R")], "r_regionkey int, r_name string"),
        "part": ([(1, "ring", "Brand#7", "SMALL", 5)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
    }
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in given}


def test_coarser_items_give_the_same_raw_rows(spark, tmp_path):
    tables = _tables(spark, tmp_path)
    whole = spark.sql(fixtures.RAW_SELECT, **tables)
    whole = whole.select(*NAMES, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")
    made = fixtures.discharge_raw(spark, str(tmp_path))
    rows = sorted(map(tuple, made.collect()), key=repr)
    assert len(rows) > len(DAYS) * len(RATES)
    assert rows == sorted(map(tuple, whole.collect()), key=repr)
    assert len({r[NAMES.index("discharge_year")] for r in rows}) == len(DAYS)


def test_days_and_rates_are_not_shuffled(spark, tmp_path):
    _tables(spark, tmp_path)
    lines = fixtures.discharge_raw(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = next(i for i, text in enumerate(lines) if "RepartitionByExpression" in text and "l_orderkey" in text)
    assert any("trunc(" in text and "l_tax" in text for text in lines[dealt + 1 : dealt + 3])
