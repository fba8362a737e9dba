"""Training history (run, epoch, value): best so far, early stopping, learning rate on a plateau, running means.

The last two depend on all epochs before in order, so they are folds over a run's epochs in one array; a run has few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_so_far(h: DataFrame, value: str) -> DataFrame:
    """is_best: larger than all before it, the first one larger than 0."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("is_best", F.col(value) > F.coalesce(F.max(value).over(before), F.lit(0.0)))


def running_mean(h: DataFrame, key: str, order: list[str], value: str, weight: str) -> DataFrame:
    """h with mean: the weighted mean of a key's rows up to each one; null while the weights sum to 0."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumn("mean", F.try_divide(F.sum(F.col(value) * F.col(weight)).over(upto), F.sum(weight).over(upto).cast("double")))


def _in_order(h: DataFrame, value: str) -> DataFrame:
    return h.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", F.col(value).cast("double").alias("v")))).alias("h"))


def early_stop(h: DataFrame, value: str, patience: int, min_delta: float = 0.001) -> DataFrame:
    """run, stop_epoch (null: never), best: stops when `patience` epochs in a row are not over best + min_delta."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stop"))

    def step(acc, x):
        better = acc["best"].isNull() | (x["v"] > acc["best"] + min_delta)
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        moved = F.struct(F.when(better, x["v"]).otherwise(acc["best"]).alias("best"), bad.alias("bad"), F.when(bad >= patience, x["epoch"].cast("int")).alias("stop"))
        return F.when(acc["stop"].isNotNull(), acc).otherwise(moved)

    return _in_order(h, value).select("run", F.aggregate("h", start, step).alias("a")).select("run", F.col("a.stop").alias("stop_epoch"), F.col("a.best").alias("best"))


def plateau_rates(h: DataFrame, value: str, rate: float, patience: int, factor: float = 0.5, floor: float = 0.01, threshold: float = 1e-4) -> DataFrame:
    """run, epoch, lr after each epoch: cut by `factor` when more than `patience` epochs in a row bring no relative gain."""
    empty = F.array().cast("array<struct<epoch:int,lr:double>>")
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("bad"), F.lit(float(rate)).alias("lr"), empty.alias("out"))

    def step(acc, x):
        better = x["v"] > F.when(acc["best"] == float("-inf"), acc["best"]).otherwise(acc["best"] + threshold * F.abs(acc["best"]))
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        cut = bad > patience
        lr = F.when(cut, F.greatest(acc["lr"] * factor, F.lit(rate * floor))).otherwise(acc["lr"])
        out = F.concat(acc["out"], F.array(F.struct(x["epoch"].cast("int").alias("epoch"), lr.alias("lr"))))
        return F.struct(F.when(better, x["v"]).otherwise(acc["best"]).alias("best"), F.when(cut, 0).otherwise(bad).alias("bad"), lr.alias("lr"), out.alias("out"))

    return _in_order(h, value).select("run", F.explode(F.aggregate("h", start, step)["out"]).alias("o")).select("run", "o.epoch", "o.lr")
