"""The 78-dimensional feature row of a frame: 36 hip-centred coordinates, 6 angles, 36 velocities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import N_SLOTS, hip_centred, joint_angles
from .sequence import array_velocity, resample_arrays


def flat(lm: Column, slots: int = N_SLOTS) -> Column:
    return F.array(*[lm[j][k] for j in range(slots) for k in "xyz"])


def landmarks(values: Column, slots: int = N_SLOTS) -> Column:
    return F.array(*[F.struct(values[3 * j].alias("x"), values[3 * j + 1].alias("y"), values[3 * j + 2].alias("z")) for j in range(slots)])


def resampled(frames: DataFrame, length: int = 60) -> DataFrame:
    """identity, video_id, frame_idx, lm: `length` frames a video, each landmark by straight lines."""
    rows = frames.select("identity", "video_id", "frame_idx", flat(F.col("lm")).alias("v"))
    return resample_arrays(rows, "video_id", "v", length).select("identity", "video_id", "frame_idx", landmarks(F.col("v")).alias("lm"))


def feature_frames(frames: DataFrame, length: int | None = 60, angles: bool = True, velocities: bool = True) -> DataFrame:
    """identity, video_id, frame_idx, feat: resampled first (unless length is None), then centred and differentiated."""
    rows = frames if length is None else resampled(frames, length)
    rows = rows.select("identity", "video_id", "frame_idx", hip_centred(F.col("lm")).alias("coords"), *([joint_angles(F.col("lm")).alias("angles")] if angles else []))
    if velocities:
        rows = array_velocity(rows, "video_id", "coords", "vel")
    parts = ["coords", *(["angles"] if angles else []), *(["vel"] if velocities else [])]
    return rows.select("identity", "video_id", "frame_idx", F.concat(*parts).alias("feat"))


def pooled(features: DataFrame, dims: int = 78) -> DataFrame:
    """identity, video_id, feat: mean over a video's frames."""
    x = F.col("feat")
    g = features.groupBy("identity", "video_id").agg(*[F.avg(x[i]).alias(f"d{i}") for i in range(dims)])
    return g.select("identity", "video_id", F.array(*[F.col(f"d{i}") for i in range(dims)]).alias("feat"))
