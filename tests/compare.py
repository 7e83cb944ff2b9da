"""Compare the named queries with their SQL on DuckDB: ``python tests/compare.py <folder> [name ...]``."""

from __future__ import annotations

import collections
import glob
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from read_parquet('{file}')")
    return connection


def normal(rows, columns) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(repr(r[i]) for i in order) for r in rows)


def spark_rows(df: DataFrame) -> tuple[list, list[str]]:
    return [tuple(r) for r in df.collect()], df.columns


def sql_rows(connection, sql: str) -> tuple[list, list[str]]:
    cursor = connection.execute(sql)
    return cursor.fetchall(), [c[0] for c in cursor.description]


def difference(df: DataFrame, connection, sql: str) -> str | None:
    """None if both give the same columns and the same bag of rows."""
    ours, our_columns = spark_rows(df)
    theirs, their_columns = sql_rows(connection, sql)
    if sorted(our_columns) != sorted(their_columns):
        return f"columns {sorted(our_columns)} != {sorted(their_columns)}"
    a, b = normal(ours, our_columns), normal(theirs, their_columns)
    if a == b:
        return None
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"rows {len(ours)} / {len(theirs)}; spark only {only_a}; sql only {only_b}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from wardline.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(cores=4)
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(folder), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        began = time.perf_counter()
        try:
            if name in sql:
                found = difference(query(spark, folder), connection, sql[name])
            else:
                found = None if query(spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        note = "" if name in sql else " (rows only)"
        print(f"{'ok ' if found is None else 'BAD'} {name}{note} {time.perf_counter() - began:.2f}s {found or ''}", flush=True)
    print(f"{bad} differ")
    spark.stop()


if __name__ == "__main__":
    main()
