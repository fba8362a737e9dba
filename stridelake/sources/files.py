"""File sources and sinks: videos, frames tables, incremental extraction, checkpoints and JSON reports."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import best_epoch

VIDEO_SUFFIX = r"\.(mp4|avi|mov|mkv|webm)$"


def video_files(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of the videos below root, by suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    files = files.where(F.lower("path").rlike(VIDEO_SUFFIX))
    return files if content else files.drop("content")


def videos_by_identity(spark: SparkSession, roots: list[str]) -> DataFrame:
    """identity (the folder of the file), paths (sorted), videos: of the videos below all roots; a root that is missing is warned of."""
    there = []
    for root in roots:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            there.append(video_files(spark, root).select("path"))
        else:
            warnings.warn(f"no folder {root}", stacklevel=2)
    found = reduce(DataFrame.unionByName, there) if there else spark.createDataFrame([], "path string")
    found = found.distinct().withColumn("identity", F.element_at(F.split("path", "/"), -2))
    # a person has a bounded number of videos
    return found.groupBy("identity").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.count("*").alias("videos"))


def decoded_frames(files: DataFrame, decoder: Callable, schema: str) -> DataFrame:
    """Rows that `decoder` makes of each (path, content); a file that fails gives one row with its error alone.

    decoder(path, content) yields dicts of the schema's columns; the schema has path and error.
    """

    columns = StructType.fromDDL(schema).names

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [r | {"path": path, "error": None} for r in decoder(path, content)]
                except Exception as e:  # noqa: BLE001  one bad file does not stop the others
                    rows = [{"path": path, "error": str(e)[:500]}]
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def new_rows(found: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of found whose key is not in done yet: what an incremental extraction still has to do."""
    return found.join(done.select(key).distinct(), key, "left_anti")


def write_frames(frames: DataFrame, path: str, mode: str = "append") -> None:
    frames.write.mode(mode).partitionBy("identity").parquet(path)


def read_frames(spark: SparkSession, path: str, people: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if people is None else df.where(F.col("identity").isin(*people))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """A report's rows: one JSON object a line, or one document a file."""
    return spark.read.option("multiLine", str(whole_files).lower()).json(path)


def flattened(report: DataFrame, *columns: str) -> DataFrame:
    """report with each of the columns, lists of lists, as one list."""
    return report.withColumns({c: F.flatten(c) for c in columns})


def latest_best(paths: DataFrame, column: str = "path") -> DataFrame:
    """One row: the path with the largest epoch_N_best, by number."""
    return paths.withColumn("epoch", best_epoch(F.col(column))).where("epoch is not null").agg(F.max_by(column, F.struct("epoch", column)).alias(column), F.max("epoch").alias("epoch"))


def save_model(spark: SparkSession, weights: dict, stats: DataFrame, path: str) -> None:
    """Weights as a table of name, shape, values beside the feature statistics."""
    rows = [(k, [int(n) for n in v.shape], [float(x) for x in v.ravel()]) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, value array<double>").write.mode("overwrite").parquet(f"{path}/weights")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_model(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    import numpy as np

    rows = spark.read.parquet(f"{path}/weights").collect()  # one row per layer
    return {r.name: np.array(r.value).reshape(r.shape) for r in rows}, spark.read.parquet(f"{path}/stats")
