"""Compares registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TESTDATA = "/root/testdata"
SPARK_SECONDS: dict[str, float] = {}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    from __spark_entry__ import oracle_sql, queries

    started = time.time()
    df = queries()[name](spark, sf_dir)
    spark_rows = df.collect()
    SPARK_SECONDS[name] = time.time() - started
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    got, want = rows_of(df.columns, spark_rows), rows_of(columns, result.fetchall())
    if got == want:
        return None
    return (
        f"{sorted(columns)}\n {sum(got.values())} rows, expected {sum(want.values())}\n"
        f" only here {list((got - want).items())[:3]}\n only there {list((want - got).items())[:3]}"
    )


def session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"{TESTDATA}/{sys.argv[1]}"
    names = sys.argv[2:] or list(queries())
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            problem = difference(spark, con, sf_dir, name) if name in oracle_sql() else "no SQL"
        except Exception as error:  # show the failing query and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None and problem != "no SQL"
        seconds = f"{SPARK_SECONDS.get(name, 0):.1f} of {time.time() - started:.1f}"
        print(f"{name:28} {seconds:>14}s {problem or 'ok'}", flush=True)
    print("different:", bad)
