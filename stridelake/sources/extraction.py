"""Extraction that goes on after it was stopped: batches of keys, each committed by one manifest.

Below a path: data/_batch=<id> has a batch's rows, log/<id> the keys of a committed batch. A run writes the manifests of its batches
beside the log, and each is renamed into it when the batch's rows are there, so a batch counts either whole or not at all. Rows of
a batch that was stopped before are never read, and its keys are done again. Nothing has to be cleaned up before a run goes on.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import new_rows
from .shared import shared_path, written

BATCH = 50
#: Tasks that rows are dealt to batches by, at most.
PARTS = 2000


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    store, at = _store(spark, path)
    return store.exists(at)


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """key, _batch of all committed batches; None before the first."""
    log = f"{path}/log"
    return spark.read.option("recursiveFileLookup", "true").parquet(log) if _exists(spark, log) else None


def extract(found: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, batch: int = BATCH, most: int | None = None, rows: DataFrame | None = None, at_once: int = 1) -> int:
    """Does `work` for the rows of found (one a key) whose keys are not committed, about `batch` keys at once; the number of batches.

    `most` batches are done at most, for runs of bounded time. Null keys are left out. Each batch is one distributed write.
    Where the work needs more than found has, `rows` has it, with any number of rows a key: they are dealt to the batches in one
    pass, and `work` is given those of its batch. A work that joins a table by itself reads all of it in every batch.
    `at_once` batches run side by side; when one fails, none is begun after it.
    """
    spark = found.sparkSession
    found = found.where(F.col(key).isNotNull())
    done = committed(spark, path)
    rest = written(found if done is None else new_rows(found, done, key), "to-extract")
    number = math.ceil(rest.count() / batch)
    nth = F.pmod(F.xxhash64(key), F.lit(max(1, number)))
    places = sorted(r[0] for r in rest.select(nth).distinct().collect())[:most]
    if not places:
        return 0
    run = f"b{uuid.uuid4().hex}"
    rest = rest.where(nth <= places[-1]).withColumn("_batch", F.concat(F.lit(f"{run}-"), nth.cast("string")))
    parts = min(len(places), PARTS)
    keys = rest.select(key, "_batch")
    # keys are even by batch; rows of a key can be many, so a large batch of them is split over tasks and files
    own = rest.repartition(parts, "_batch") if rows is None else rows.join(keys, key).hint("rebalance", parts, F.col("_batch"))
    own.write.partitionBy("_batch").parquet(dealt := shared_path(spark, "dealt"))
    own = spark.read.schema(own.schema).parquet(dealt)
    keys.withColumn("_of", F.col("_batch")).repartition(parts, "_of").write.partitionBy("_of").parquet(f"{path}/pending/{run}")
    failed = []

    def one(name: str) -> int:
        if failed:
            return 0
        try:
            work(own.where(F.col("_batch") == name).drop("_batch")).write.parquet(f"{path}/data/_batch={name}")
            store, log = _store(spark, f"{path}/log")
            store.mkdirs(log)
            if not store.rename(_store(spark, f"{path}/pending/{run}/_of={name}")[1], _store(spark, f"{path}/log/{name}")[1]):
                raise OSError(f"the manifest of batch {name} could not be renamed")
        except BaseException:
            failed.append(name)
            raise
        return 1

    with ThreadPoolExecutor(at_once) as pool:
        try:
            return sum(f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), f"{run}-{n}") for n in places])
        except BaseException:
            failed.append(run)
            raise


def extracted(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed batches; None before the first."""
    done = committed(spark, path)
    if done is None:
        return None
    return spark.read.parquet(f"{path}/data").join(done.select("_batch").distinct(), "_batch", "left_semi").drop("_batch")
