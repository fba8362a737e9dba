"""Which of a person's clips is taken: by an order of views, and for swapped videos by the person whose body they show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import stem, swapped_names

#: Orders of views, by what the clip is for.
ORDERS = {
    "original": ("F1", "F2", "S1", "F3"),
    "face": ("F1", "F2", "F3"),
    "skeleton": ("S1", "S2", "S3", "F1", "F2"),
    "walk": ("S1", "S2", "F1"),
}


def preferred(clips: DataFrame, order: tuple[str, ...], any_last: bool = False) -> DataFrame:
    """identity, path: of clips (identity, view, path) the one whose view comes first in `order`, of equal ones the first path.

    People without such a view are left out, or with `any_last` get their first path by name.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.coalesce("view", F.lit("")))
    ranked = clips.withColumn("_rank", F.when(rank > 0, rank).otherwise(len(order) + 1))
    if not any_last:
        ranked = ranked.where(F.col("_rank") <= len(order))
    return ranked.groupBy("identity").agg(F.min_by("path", F.struct("_rank", "path")).alias("path"))


def with_originals(swapped: DataFrame, clips: DataFrame, order: tuple[str, ...] = ORDERS["original"], any_last: bool = False) -> DataFrame:
    """name, body, face, path of swapped videos (name): path is the preferred clip of the body's person, null where none is."""
    named = swapped.select("name", swapped_names(F.col("name")).alias("_n")).select("name", "_n.body", "_n.face")
    return named.join(preferred(clips, order, any_last).withColumnRenamed("identity", "body"), "body", "left").select("name", "body", "face", "path")


def one_of_each(videos: DataFrame) -> DataFrame:
    """stem, path: of videos (path) of several roots one of each name, the first by path."""
    return videos.groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias("path"))
