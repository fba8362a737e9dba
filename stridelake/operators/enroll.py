"""Enrolment and pairs: signatures, feature statistics, positive and negative pairs, triplets, leave-one-out roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_stats(v: DataFrame, column: str, dims: int) -> DataFrame:
    """dim, mean, std (sample; 1 where it is under 1e-6): one row a dimension, from one pass over the rows."""
    x = F.col(column)
    sums = v.agg(*[F.avg(x[i]).alias(f"m{i}") for i in range(dims)], *[F.stddev_samp(x[i]).alias(f"s{i}") for i in range(dims)])
    rows = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i in range(dims)])
    one = sums.select(F.explode(rows).alias("r")).select("r.dim", "r.mean", "r.std")
    return one.withColumn("std", F.when(F.coalesce(F.col("std"), F.lit(0.0)) < 1e-6, F.lit(1.0)).otherwise(F.col("std")))


def zscore(v: DataFrame, stats: DataFrame, column: str, eps: float = 0.0) -> DataFrame:
    """column less mean over std; the statistics are one row of arrays, of as many elements as dimensions."""
    both = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))
    scaled = F.zip_with(F.col(column), F.col("_s"), lambda x, s: (x - s["mean"]) / (s["std"] + eps))
    return v.crossJoin(F.broadcast(both)).withColumn(column, scaled).drop("_s")


def frame_signatures(frames: DataFrame, column: str, dims: int, min_videos: int = 1) -> DataFrame:
    """identity, frame_idx, sig, num_videos: element-wise mean over an identity's videos."""
    x = F.col(column)
    g = frames.groupBy("identity", "frame_idx").agg(F.count_distinct("video_id").alias("num_videos"), *[F.avg(x[i]).alias(f"d{i}") for i in range(dims)])
    return g.where(F.col("num_videos") >= min_videos).select("identity", "frame_idx", F.array(*[F.col(f"d{i}") for i in range(dims)]).alias("sig"), "num_videos")


def leave_self_out(v: DataFrame, column: str, dims: int) -> DataFrame:
    """Every row with the mean of its identity's other rows (null where it is alone): (sum - own) / (n - 1)."""
    x, n = F.col(column), F.col("_n")
    sums = v.groupBy("identity").agg(F.count("*").alias("_n"), *[F.sum(x[i]).alias(f"_d{i}") for i in range(dims)])
    other = F.array(*[F.try_divide(F.col(f"_d{i}") - x[i], n - 1) for i in range(dims)])
    return v.join(sums, "identity").withColumn("others", F.when(n > 1, other)).drop("_n", *[f"_d{i}" for i in range(dims)])


def placed(people: DataFrame, digest: Column) -> DataFrame:
    """people (identity, ...), one row each, with place (from 0, by digest, then by name) and people (how many there are).

    Digests fall evenly into 4096 ranges; each is numbered by itself and gets the number of people before it, so no task
    has to see them all.
    """
    d = people.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, 3))
    n = d.groupBy("_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(F.lit(1)).orderBy("_range")  # one row a range
    n = n.select("_range", (F.sum("_n").over(whole) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("people"))
    own = Window.partitionBy("_range").orderBy("_digest", "identity")
    place = (F.row_number().over(own) - 1 + F.col("_before")).cast("long")
    return d.join(F.broadcast(n), "_range").withColumn("place", place).drop("_digest", "_range", "_before")


def _follower(people: DataFrame, column: str, name: str) -> DataFrame:
    """people (placed) with `column` of the one at the next place, the first after the last."""
    after = people.select(F.pmod(F.col("place") - 1, F.col("people")).alias("place"), F.col(column).alias(name))
    return people.join(after, "place")


def enrolled_pairs(probes: DataFrame, people: DataFrame) -> DataFrame:
    """Two pairs a probe (key, true_identity): its own identity (label 1), and another enrolled one (0) that its digest picks.

    People stand in a ring by the digests of their names; the digest of the key says how many places on from its own the
    other one is. So both are equi-joins, and the picks are the same on every engine and in every run.
    """
    places = placed(people.select("identity"), F.md5("identity"))
    own = probes.join(places.withColumnRenamed("identity", "true_identity"), "true_identity")
    digest = F.conv(F.substring(F.md5(F.col("key").cast("string")), 1, 8), 16, 10).cast("long")
    other = own.where("people > 1").withColumn("place", F.pmod(F.col("place") + 1 + F.pmod(digest, F.col("people") - 1), F.col("people")))
    other = other.join(places.select("place", F.col("identity").alias("claimed_identity")), "place")
    own = own.select("key", "true_identity", F.col("true_identity").alias("claimed_identity"), F.lit(1).alias("label"))
    return own.unionByName(other.select("key", "true_identity", "claimed_identity", F.lit(0).alias("label")))


def next_in_ring(people: DataFrame) -> DataFrame:
    """identity, next_identity: people, one row each, stand in a ring by the digests of their names; the first follows the last."""
    return _follower(placed(people.select("identity"), F.md5("identity")), "identity", "next_identity").select("identity", "next_identity")


def unenrolled(probes: DataFrame, people: DataFrame) -> DataFrame:
    return probes.join(people.select(F.col("identity").alias("claimed_identity")), "claimed_identity", "left_anti")


def require_enrolled(probes: DataFrame, people: DataFrame) -> DataFrame:
    """probes, or an error that names a claim of an identity that is not enrolled."""
    if missing := unenrolled(probes, people).limit(1).collect():
        raise KeyError(f"{missing[0].claimed_identity} is not enrolled")
    return probes


def triplets(videos: DataFrame) -> DataFrame:
    """anchor, positive, negative: another video of the same person (itself if there is none), one of another person.

    videos: video_id, identity. Each person's next video by digest is the positive; the negative is the video with the
    largest digest of the person who follows by digest, so that no pairs are formed.
    """
    w = Window.partitionBy("identity").orderBy(F.md5("video_id"), "video_id")
    v = videos.withColumn("next", F.coalesce(F.lead("video_id").over(w), F.first("video_id").over(w)))
    reps = videos.groupBy("identity").agg(F.max_by("video_id", F.md5("video_id")).alias("rep"))
    people = _follower(placed(reps, F.md5("identity")), "rep", "negative")
    return v.join(people.select("identity", "negative"), "identity").select(F.col("video_id").alias("anchor"), F.col("next").alias("positive"), "negative", F.col("identity").alias("anchor_person"))


def comparison_features(a: Column, b: Column) -> Column:
    """Difference, its size, and product, one after the other."""
    return F.concat(F.zip_with(a, b, lambda x, y: x - y), F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def split_people(people: DataFrame, ratio: float, seed: str) -> DataFrame:
    """identity, part: the first int(n ratio) people by digest are train, the rest validation."""
    p = placed(people, F.md5(F.concat_ws("|", F.lit(seed), "identity")))
    return p.withColumn("part", F.when(F.col("place") < F.floor(F.col("people") * ratio), "train").otherwise("validation")).drop("place", "people")


def best_match(scored: DataFrame, key: str = "vec_id") -> DataFrame:
    """Per probe the claimed identity with the largest score; of equal ones the first by name."""
    best = F.max(F.struct("score", F.col("claimed_identity").alias("name")))
    first = scored.groupBy(key).agg(best.alias("b"), F.max("true_identity").alias("true_identity"))
    return first.select(key, "true_identity", F.col("b.name").alias("best_identity"), F.col("b.score").alias("best_score"))


def top_scores(scored: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), "claimed_identity")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
