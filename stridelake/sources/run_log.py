"""What is known of a run: scalars by epoch in long form, and checks that are taken while a table is written.

Checks are aggregates observed in the write's own tasks, so no table is read again for them. In Spark 4.1 a session that has
observed anything can't transform by a logistic regression that it has just fit (the model's summary holds the session, which
is not serializable any more); train.score reads the coefficients instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCALARS = "run string, epoch int, name string, value double"


def append_scalars(spark: SparkSession, log: str, run: str, epoch: int, values: dict[str, float | None]) -> None:
    rows = [(run, epoch, k, None if v is None else float(v)) for k, v in sorted(values.items())]
    spark.createDataFrame(rows, SCALARS).coalesce(1).write.mode("append").parquet(log)


def scalars(history: DataFrame, run: str, epoch: str, names: dict[str, str]) -> DataFrame:
    """SCALARS rows of a wide history: `names` gives each column's scalar; all in one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for c, n in names.items()])
    return history.select(F.col(run).cast("string").alias("run"), F.col(epoch).cast("int").alias("epoch"), F.explode(pairs).alias("s")).select("run", "epoch", "s.*")


def frame_checks(video: str, values: str, length: int, dims: int) -> dict[str, Column]:
    """Checks of a table of a row a frame: row and null counts, sizes that differ, and for each place of a sequence how many
    videos have it and the digest of their names."""
    at, v = F.col("frame_idx"), F.col(values)
    checks = {
        "rows": F.count(F.lit(1)), "nulls": F.count_if(v.isNull()), "last": F.max(at),
        "other_sizes": F.count_if(F.size(v) != dims), "null_numbers": F.sum(F.size(F.filter(v, lambda x: x.isNull() | F.isnan(x)))),
    }
    name = F.xxhash64(video)
    for i in range(length):
        checks |= {f"n{i}": F.count_if(at == i), f"names{i}": F.bit_xor(F.when(at == i, name))}
    return checks


def frame_summary(seen: dict, length: int) -> dict[str, float | None]:
    """rows, videos, nulls, other_sizes, null_numbers, last and complete (1: every video has each place once) of what was observed."""
    places = {(seen[f"n{i}"], seen[f"names{i}"]) for i in range(length)}
    whole = len(places) == 1 and seen["rows"] == length * seen["n0"] and (seen["last"] is None or seen["last"] == length - 1)
    own = {k: seen[k] or 0 for k in ("rows", "nulls", "other_sizes", "null_numbers")}
    return own | {"videos": seen["n0"], "last": seen["last"], "complete": int(whole)}


def write_checked(df: DataFrame, path: str, checks: dict[str, Column], mode: str = "errorifexists") -> dict:
    """Writes df as Parquet and gives the values of the checks over the rows that were written.

    A check is any aggregate that Spark can observe (none with distinct). A table without rows gives counts of 0 and null sums.
    """
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in checks.items()]).write.mode(mode).parquet(path)
    return seen.get
