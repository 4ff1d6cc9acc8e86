"""Run registered queries in Spark and in DuckDB on one data folder and compare the results.

usage: python -m checks.compare FOLDER [QUERY ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import ORACLE
from reviewmill.plans.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reviewmill")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    """NaN compares equal to itself; numbers keep their type, so that 1 and 1.0 differ."""
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"float {value!r}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return (type(value).__name__, value)


def normal_form(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def differences(name: str, spark: SparkSession, connection, folder: str) -> str | None:
    """None when both engines agree, else what differs."""
    columns, rows = spark_rows(QUERIES[name](spark, folder))
    if name not in ORACLE:
        return None if rows else "no rows"
    expected_columns, expected = duck_rows(connection, ORACLE[name])
    if sorted(columns) != sorted(expected_columns):
        return f"columns {sorted(columns)} != {sorted(expected_columns)}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    for got, want in zip(normal_form(columns, rows), normal_form(expected_columns, expected)):
        if got != want:
            return f"\n   spark {str(got)[:600]}\n  duckdb {str(want)[:600]}"
    return None


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, connection = session(), duck(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = differences(name, spark, connection, folder)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        kind = "ok" if name in ORACLE else "rows"
        print(f"{name:24s} {time.time() - start:6.2f}s {'DIFF ' + problem if problem else kind}",
              flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
