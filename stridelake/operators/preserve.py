"""Does a motion survive an edit? Key-point share, cosine, distances, and correlations of step width and symmetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import N_SLOTS, dot, hip_centred, joint_angles, step_width, symmetry, torso, total


def correlation(a: str, b: str) -> Column:
    """Pearson's r; null where either is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def aligned(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """pair_id, frame_idx, a, b (landmarks): frames of both videos of a pair, up to the shorter one's end.

    pairs: pair_id, video_a, video_b; frames: video_id, frame_idx, lm.
    """
    left = pairs.join(frames, pairs.video_a == frames.video_id).select("pair_id", "frame_idx", F.col("lm").alias("a"))
    right = pairs.join(frames, pairs.video_b == frames.video_id).select("pair_id", "frame_idx", F.col("lm").alias("b"))
    return left.join(right, ["pair_id", "frame_idx"])


def preservation(both: DataFrame, torso_mode: str = "shoulder_ankle", pck_share: float = 0.05) -> DataFrame:
    """One row a pair of its frames (pair_id, a, b): scores, criteria and verdict (two of three)."""
    f = both.select("pair_id", hip_centred(F.col("a")).alias("ca"), hip_centred(F.col("b")).alias("cb"), joint_angles(F.col("a")).alias("ga"), joint_angles(F.col("b")).alias("gb"), *[step_width(F.col(x)).alias(f"step_{x}") for x in "ab"])
    ca, cb, n = F.col("ca"), F.col("cb"), 3 * N_SLOTS
    gap = [F.sqrt(total((ca[3 * j + k] - cb[3 * j + k]) * (ca[3 * j + k] - cb[3 * j + k]) for k in range(3))) for j in range(N_SLOTS)]
    f = f.select(
        "pair_id", "step_a", "step_b", symmetry(ca).alias("sym_a"), symmetry(cb).alias("sym_b"),
        torso(ca, torso_mode).alias("scale"), F.array(*gap).alias("gap"),
        (dot(ca, cb, n) / (F.sqrt(dot(ca, ca, n)) * F.sqrt(dot(cb, cb, n)) + 1e-8)).alias("cosine"),
        F.sqrt(total((F.col("ga")[i] - F.col("gb")[i]) * (F.col("ga")[i] - F.col("gb")[i]) for i in range(6))).alias("l2_angles"),
    )
    g = F.col("gap")
    f = f.withColumn("pck", total(F.when(g[j] < pck_share * F.col("scale"), 1.0).otherwise(0.0) for j in range(N_SLOTS)) / N_SLOTS)
    f = f.withColumn("l2", F.sqrt(total(g[j] * g[j] for j in range(N_SLOTS)))).withColumn("l2_landmark", total(g[j] for j in range(N_SLOTS)) / N_SLOTS)
    out = f.groupBy("pair_id").agg(
        F.avg("pck").alias("pck_score"), F.avg("cosine").alias("mean_cosine"), F.avg("l2").alias("mean_l2_coords"), F.avg("l2_landmark").alias("mean_per_landmark_l2"),
        F.avg("l2_angles").alias("mean_l2_angles"), correlation("step_a", "step_b").alias("step_correlation"), correlation("sym_a", "sym_b").alias("symmetry_correlation"),
    )
    passes = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({"corr_pass": passes((F.col("step_correlation") >= 0.85) & (F.col("symmetry_correlation") >= 0.85)), "pck_pass": passes(F.col("pck_score") >= 0.9), "cosine_pass": passes(F.col("mean_cosine") >= 0.95)})
    count = total(F.col(c).cast("int") for c in ("corr_pass", "pck_pass", "cosine_pass"))
    return out.withColumn("pass_count", count).withColumn("preserved", F.col("pass_count") >= 2)


def jittered(frames: DataFrame, size: float | Column) -> DataFrame:
    """Landmarks whose x is moved by a small amount that depends on frame and slot."""
    move = lambda lm: F.transform(lm, lambda p, j: F.struct((p["x"] + (((F.col("frame_idx") + j) % 7) - 3) * size).alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    return frames.withColumn("lm", move(F.col("lm")))
