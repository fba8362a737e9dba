"""Headline queries, median of warm runs: prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import sequence
from stridelake.plans.catalog import QUERIES
from stridelake.sources.surrogate import table

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ("feature_vector_78", "resample_linear_60", "velocity", "enroll_signature", "identify_1_to_n", "gait_preservation", "roc_auc", "eer", "head_forward")


def lineitem_velocity(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of prices along each order's lines: the window operator on a large table."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("frame_idx"), "l_extendedprice")
    return sequence.velocity(rows, "l_orderkey", "l_extendedprice")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {k: QUERIES[k] for k in HEADLINE} | {"lineitem_velocity": lineitem_velocity}
    seconds = {}
    for name, f in queries.items():
        took = []
        for _ in range(RUNS + 1):  # the first one warms up
            began = time.perf_counter()
            f(spark, SF).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF.rstrip("/").rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
