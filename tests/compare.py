"""Runs queries beside their DuckDB SQL: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads to 4")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x + 0.0:.6g}"
    if type(x).__name__ == "Decimal":
        return f"{float(x):.6g}"
    return str(x) if x is not None and not isinstance(x, int | bool | str) else x


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def differences(df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    a, b = table(df.columns, df.collect()), table([d[0] for d in found.description], found.fetchall())
    if a[0] != b[0]:
        return [f"columns {a[0]} and {b[0]}"]
    if len(a[1]) != len(b[1]):
        return [f"{len(a[1])} and {len(b[1])} rows"]
    return [f"{x} and {y}" for x, y in zip(a[1], b[1], strict=True) if x != y][:3]


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = views(sf_dir), 0
    for name, f in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            sql = e.oracle_sql().get(name)
            wrong = differences(f(spark, sf_dir), con, sql) if sql else []
            note = f"{f(spark, sf_dir).count()} rows only" if not sql else "equal"
        except Exception as x:  # noqa: BLE001
            wrong, note = [f"{type(x).__name__}: {str(x)[:600]}"], ""
        bad += bool(wrong)
        print(f"{name}: {'DIFFERENT ' + str(wrong) if wrong else note} ({time.time() - t:.1f} s)", flush=True)
    print("all equal" if not bad else f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
