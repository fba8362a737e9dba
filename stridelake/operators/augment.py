"""Augmentations of landmarks in unit image coordinates, and the plan of which videos still need which."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import gaussian

#: Names of spatial and temporal augmentations.
SPATIAL = ("hflip", "bright_up", "bright_down", "contrast_up", "rotate_left", "rotate_right", "blur", "color_jitter", "grayscale", "combined_1", "noise", "zoom_in")
TEMPORAL = ("slow", "fast", "reverse")


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def hflip(lm: Column, slots: int = 12) -> Column:
    """x becomes 1 - x, and left and right slots change places."""
    return F.array(*[_point(1 - lm[j ^ 1]["x"], lm[j ^ 1]["y"], lm[j ^ 1]["z"]) for j in range(slots)])


def rotate(lm: Column, degrees: float, slots: int = 12) -> Column:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return F.array(*[_point((lm[j]["x"] - 0.5) * c - (lm[j]["y"] - 0.5) * s + 0.5, (lm[j]["x"] - 0.5) * s + (lm[j]["y"] - 0.5) * c + 0.5, lm[j]["z"]) for j in range(slots)])


def zoom(lm: Column, factor: float, slots: int = 12) -> Column:
    return F.array(*[_point((lm[j]["x"] - 0.5) * factor + 0.5, (lm[j]["y"] - 0.5) * factor + 0.5, lm[j]["z"]) for j in range(slots)])


def noise(lm: Column, key: Column, size: float, slots: int = 12) -> Column:
    """Gaussian noise of the given spread on x and y, fixed by key, slot and axis."""

    def g(j: int, axis: int) -> Column:
        return gaussian(key, j, axis) * size

    return F.array(*[_point(lm[j]["x"] + g(j, 0), lm[j]["y"] + g(j, 1), lm[j]["z"]) for j in range(slots)])


def plan(spark: SparkSession, videos: DataFrame, existing: DataFrame) -> DataFrame:
    """video_id, augmentation: every video with every augmentation (fifteen rows, so a fixed broadcast), less what exists."""
    kinds = spark.createDataFrame([(k,) for k in SPATIAL + TEMPORAL], "augmentation string")
    return videos.select("video_id").crossJoin(F.broadcast(kinds)).join(existing, ["video_id", "augmentation"], "left_anti")
