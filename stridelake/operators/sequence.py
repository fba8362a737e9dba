"""Operators on ordered rows of a key: derivatives, resampling, padding, tiling and temporal changes.

All take frames with a key and a frame_idx from 0 without gaps. Resampling and its like work from each source row: the row
itself, with the next one's value, yields the targets that fall on it, so no sequence is gathered and no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import gaussian


def by(key: str):
    return Window.partitionBy(key).orderBy("frame_idx")


def velocity(df: DataFrame, key: str, value: str, out: str = "velocity") -> DataFrame:
    """Forward difference; the last row repeats the one before it (0 in a sequence of one)."""
    w, v = by(key), F.col(value)
    ahead = F.lead(v).over(w) - v
    return df.withColumn(out, F.coalesce(ahead, v - F.lag(v).over(w), F.lit(0.0)))


def acceleration(df: DataFrame, key: str, value: str, out: str = "acceleration") -> DataFrame:
    """Forward difference of the velocity: the last two rows are 0."""
    w, v = by(key), F.col(value)
    one, two = F.lead(v, 1).over(w), F.lead(v, 2).over(w)
    return df.withColumn(out, F.coalesce(two - 2 * one + v, F.lit(0.0)))


def array_velocity(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """velocity of an array column, element by element."""
    w, v = by(key), F.col(value)
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    return df.withColumn(out, F.coalesce(less(F.lead(v).over(w), v), less(v, F.lag(v).over(w)), F.transform(v, lambda x: x * 0.0)))


def _ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("int")


def targets(n: Column, length: int | Column, at: Column) -> Column:
    """Target places i with floor(i (n - 1) / (length - 1)) = at, in whole numbers; null where there are none."""
    last = length - 1 if isinstance(length, Column) else F.lit(length - 1)
    step = F.greatest(n - 1, F.lit(1))
    low = _ceil_div(at * last, step)
    high = F.when(n == 1, last).when(at == n - 1, last).otherwise(_ceil_div((at + 1) * last, step) - 1)
    return F.when(low <= high, F.sequence(low, high))


def with_length(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("n", F.count("*").over(Window.partitionBy(key)))


def resample(df: DataFrame, key: str, value: str, length: int = 60) -> DataFrame:
    """key, i, value: `length` rows a key, by straight lines between neighbours; the sequence itself where it has that length."""
    w = by(key)
    df = with_length(df, key).withColumn("ahead", F.coalesce(F.lead(value).over(w), F.col(value)))
    df = df.withColumn("i", F.explode(targets(F.col("n"), length, F.col("frame_idx"))))
    share = (F.col("i") * (F.col("n") - 1) - F.col("frame_idx") * (length - 1)) / F.lit(float(length - 1))
    return df.select(key, "i", (F.col(value) + (F.col("ahead") - F.col(value)) * share).alias(value))


def resample_to(df: DataFrame, key: str, value: str, length: str) -> DataFrame:
    """resample to the number of rows that column `length` names for each key; a length of one takes the first row."""
    w, k = by(key), F.col(length).cast("int")
    df = with_length(df, key).withColumn("ahead", F.coalesce(F.lead(value).over(w), F.col(value)))
    at = F.when(k > 1, targets(F.col("n"), k, F.col("frame_idx"))).when((k == 1) & (F.col("frame_idx") == 0), F.array(F.lit(0)))
    df = df.withColumn("i", F.explode(at))
    share = (F.col("i") * (F.col("n") - 1) - F.col("frame_idx") * (k - 1)) / F.greatest(k - 1, F.lit(1)).cast("double")
    return df.select(key, "i", (F.col(value) + (F.col("ahead") - F.col(value)) * share).alias(value))


def resample_arrays(df: DataFrame, key: str, value: str, length: int = 60) -> DataFrame:
    """resample of an array column; other columns of the source row are kept."""
    w = by(key)
    df = with_length(df, key).withColumn("ahead", F.coalesce(F.lead(value).over(w), F.col(value)))
    df = df.withColumn("i", F.explode(targets(F.col("n"), length, F.col("frame_idx"))))
    share = (F.col("i") * (F.col("n") - 1) - F.col("frame_idx") * (length - 1)) / F.lit(float(length - 1))
    mixed = F.zip_with(value, "ahead", lambda a, b: a + (b - a) * share)
    return df.withColumn(value, mixed).withColumn("frame_idx", F.col("i")).drop("ahead", "i", "n")


def sample_uniform(df: DataFrame, key: str, k: int) -> DataFrame:
    """k evenly spaced rows a key, places cut down to whole numbers; column i is the place in the sample."""
    return with_length(df, key).withColumn("i", F.explode(targets(F.col("n"), k, F.col("frame_idx")))).drop("n")


def sample_band(df: DataFrame, key: str, k: int, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """k rows a key (2 or more), evenly spaced from low * n to high * n, places cut down; column i is the place in the sample."""
    df = with_length(df, key)
    wanted = df.where("frame_idx = 0").select(F.col(key), F.col("n"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    begin, end = F.col("n") * F.lit(float(low)), F.col("n") * F.lit(float(high))
    place = F.when(F.col("i") == k - 1, end).otherwise(begin + F.col("i") * ((end - begin) / F.lit(float(k - 1))))
    wanted = wanted.select(key, "i", F.least(F.floor(place), F.col("n") - 1).cast("int").alias("frame_idx"))
    return df.drop("n").join(wanted, [key, "frame_idx"])


def best_frames(df: DataFrame, key: str, area: Column, k: int = 20, least: int = 10) -> DataFrame:
    """key, frame_idx, area: of k frames from a tenth to nine tenths of the sequence the one with the largest area, of equal ones
    the first. An area of null or 0 is no face; where no sampled frame has one, the middle frame stands in, with area null.
    Keys of fewer than `least` frames are left out.
    """
    df = with_length(df, key).where(F.col("n") >= least)
    sampled = sample_band(df.select(key, "frame_idx", area.alias("_area")), key, k).where("_area > 0")
    best = sampled.groupBy(key).agg(F.max(F.struct("_area", (-F.col("frame_idx")).alias("_f"))).alias("_b"))
    middle = df.where("frame_idx = 0").select(key, F.floor(F.col("n") / 2).cast("int").alias("_middle"))
    out = middle.join(best, key, "left")
    return out.select(key, F.coalesce(-F.col("_b._f"), F.col("_middle")).alias("frame_idx"), F.col("_b._area").alias("area"))


def tile(df: DataFrame, key: str, length: int = 60) -> DataFrame:
    """The first `length` rows, or the sequence over and over until there are so many."""
    df = with_length(df, key).where(F.col("frame_idx") < length)
    return df.withColumn("i", F.explode(F.sequence(F.col("frame_idx"), F.lit(length - 1), F.col("n").cast("int")))).drop("n")


def edge_pad(df: DataFrame, key: str, length: int = 60) -> DataFrame:
    """The first `length` rows, the last of a shorter sequence repeated."""
    df = with_length(df, key).where(F.col("frame_idx") < length)
    stop = F.when(F.col("frame_idx") == F.col("n") - 1, F.lit(length - 1)).otherwise(F.col("frame_idx"))
    return df.withColumn("i", F.explode(F.sequence(F.col("frame_idx"), stop))).drop("n")


def reverse(df: DataFrame, key: str) -> DataFrame:
    return with_length(df, key).withColumn("frame_idx", F.col("n") - 1 - F.col("frame_idx")).drop("n")


def jitter(df: DataFrame, key: str, strength: float = 0.1) -> DataFrame:
    """Every place i of a key gets the row whose place is int(gaussian * strength * n) further, within the ends; fixed by key and i."""
    df = with_length(df, key)
    move = (gaussian(F.col(key), F.col("frame_idx")) * F.lit(float(strength)) * F.col("n")).cast("int")
    place = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("frame_idx") + move)).cast("int")
    wanted = df.select(key, F.col("frame_idx").alias("i"), place.alias("frame_idx"))
    return df.drop("n").join(wanted, [key, "frame_idx"])


def change_speed(df: DataFrame, key: str, factor: float) -> DataFrame:
    """max(1, int(n / factor)) rows a key, each the source row nearest to its even place, halves to the even one."""
    df = with_length(df, key)
    count = F.greatest(F.lit(1), F.floor(F.col("n") / F.lit(float(factor))).cast("int"))
    wanted = df.where("frame_idx = 0").select(F.col(key), "n", count.alias("count")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    place = F.when(F.col("count") == 1, F.lit(0)).otherwise(F.bround(F.col("i") * (F.col("n") - 1) / F.greatest(F.col("count") - 1, F.lit(1)).cast("double"), 0).cast("int"))
    return df.drop("n").join(wanted.select(key, "i", place.alias("frame_idx")), [key, "frame_idx"])


def movement_attention(df: DataFrame, key: str, lm: str = "lm", slots: int = 21) -> DataFrame:
    """attention: summed |dx| + |dy| of all landmarks since the last frame (the first repeats the second), over the largest."""
    w = by(key)
    now, last = F.col(lm), F.lag(lm).over(w)
    df = df.withColumn("_before", last)
    moved = sum((F.abs(now[j][k] - F.col("_before")[j][k]) for j in range(slots) for k in "xy"), F.lit(0.0))
    df = df.withColumn("_moved", moved).withColumn("_moved", F.coalesce("_moved", F.lead("_moved").over(w), F.lit(0.0)))
    return df.withColumn("attention", F.col("_moved") / (F.max("_moved").over(Window.partitionBy(key)) + 1e-8)).drop("_before", "_moved")


def valid_videos(df: DataFrame, key: str = "video_id", least: int = 10) -> DataFrame:
    """Frames with a pose, renumbered without gaps, of keys that have at least `least` of them."""
    df = df.where("lm is not null").withColumn("source_idx", F.col("frame_idx"))
    df = df.withColumn("frame_idx", F.row_number().over(Window.partitionBy(key).orderBy("source_idx")) - 1)
    return with_length(df, key).where(F.col("n") >= least).drop("n")
