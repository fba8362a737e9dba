"""Roll-ups of input attributions (sample_id, frame_idx, dim, value) to joints, angles and feature groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import N_SLOTS


def group_of(dim: Column) -> Column:
    return F.when(dim < 36, "coords").when(dim < 42, "angles").otherwise("velocities")


def joint_of(dim: Column) -> Column:
    """Slot of a coordinate or velocity dimension; null for angles."""
    return F.when(dim < 36, F.floor(dim / 3)).when(dim >= 42, F.floor((dim - 42) / 3)).cast("int")


def group_shares(a: DataFrame) -> DataFrame:
    g = a.groupBy(group_of(F.col("dim")).alias("feature_group")).agg(F.sum("value").alias("total"))
    return g.withColumn("share", F.try_divide("total", F.sum("total").over(Window.partitionBy(F.lit(1)))))  # three rows


def joint_importance(a: DataFrame) -> DataFrame:
    """joint, importance (over the largest), rank: coordinates and velocities summed, averaged over samples."""
    per = a.where(joint_of(F.col("dim")).isNotNull()).groupBy("sample_id", joint_of(F.col("dim")).alias("joint")).agg(F.sum("value").alias("v"))
    mean = per.groupBy("joint").agg(F.avg("v").alias("v"))
    all_ = Window.partitionBy(F.lit(1))  # a row a joint
    out = mean.withColumn("importance", F.try_divide("v", F.max("v").over(all_)))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("v", 6)), "joint"))).drop("v")


def min_max(df: DataFrame, value: str) -> DataFrame:
    """value between its least (0) and largest (1); 0.5 where all are equal."""
    all_ = Window.partitionBy(F.lit(1))
    lo, hi = F.min(value).over(all_), F.max(value).over(all_)
    return df.withColumn("scaled", F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.5)))


def temporal(a: DataFrame) -> DataFrame:
    """sample_id, frame_idx, weight: a frame's summed attribution over the sample's largest."""
    t = a.groupBy("sample_id", "frame_idx").agg(F.sum("value").alias("v"))
    return t.withColumn("weight", F.try_divide("v", F.max("v").over(Window.partitionBy("sample_id")))).drop("v")


def few_per_person(v: DataFrame, most: int) -> DataFrame:
    """max(1, most // people) videos a person, by name, and no more than `most` in all."""
    people = v.select(F.count_distinct("identity").alias("people"))
    w = Window.partitionBy("identity").orderBy("video_id")
    v = v.withColumn("nth", F.row_number().over(w)).crossJoin(F.broadcast(people))
    return v.where(F.col("nth") <= F.greatest(F.lit(1), F.floor(most / F.col("people")))).drop("people").orderBy("nth", "identity").limit(most)


JOINTS = N_SLOTS
