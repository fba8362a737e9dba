"""python -m stridelake queries | sql NAME | run NAME --tables DIR [--out DIR] [--rows N]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.catalog import ORACLE_SQL, QUERIES


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stridelake")
    p.add_argument("mode", choices=["queries", "sql", "run"])
    p.add_argument("name", nargs="?")
    p.add_argument("--tables", help="folder of the tables' Parquet files")
    p.add_argument("--out", help="folder for the result as Parquet; without it, rows are shown")
    p.add_argument("--rows", type=int, default=20)
    a = p.parse_args(argv)
    if a.mode == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    if a.name not in QUERIES:
        p.error(f"no query {a.name!r}")
    if a.mode == "sql":
        print(ORACLE_SQL.get(a.name, "-- no SQL form"))
        return 0
    if not a.tables:
        p.error("run needs --tables")
    spark = SparkSession.builder.appName(f"stridelake {a.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = QUERIES[a.name](spark, a.tables)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
