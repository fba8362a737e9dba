"""Pose frames, ordered series and scored pairs, as views of the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import cosine, norm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, identity, e (64 doubles)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("identity"), F.col("embedding").cast("array<double>").alias("e"))


def pose_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity, video_id, frame_idx, lm (21 landmarks; the first 12 in slot order)."""
    v = vectors(spark, sf_dir).withColumn("video_id", F.concat_ws("_", "identity", (F.col("vec_id") % 3).cast("string")))
    order = Window.partitionBy("video_id").orderBy("vec_id")
    e = F.col("e")
    lm = F.array(*[F.struct(e[3 * j].alias("x"), e[3 * j + 1].alias("y"), e[3 * j + 2].alias("z")) for j in range(21)])
    return v.select("identity", "video_id", (F.row_number().over(order) - 1).alias("frame_idx"), lm.alias("lm"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, frame_idx, value: each user's events in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return e.select("user_id", "event_id", (F.row_number().over(order) - 1).alias("frame_idx"), "value")


def signatures(v: DataFrame, dims: int = 64) -> DataFrame:
    """identity, sig (mean of each dimension), n: dimensions are averaged side by side, so nothing is exploded."""
    means = v.groupBy("identity").agg(F.count("*").alias("n"), *[F.avg(F.col("e")[i]).alias(f"d{i}") for i in range(dims)])
    return means.select("identity", F.array(*[F.col(f"d{i}") for i in range(dims)]).alias("sig"), "n")


#: A broadcast of signatures holds at most so many (64 doubles each: about 60 MB).
BROADCAST_SIGNATURES = 100_000


def small(df: DataFrame, most: int) -> DataFrame:
    """df, with a broadcast hint only if it has been counted to be of at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, true_identity, claimed_identity, label, score: every vector against every identity's signature."""
    v = vectors(spark, sf_dir)
    s = signatures(v).select(F.col("identity").alias("claimed_identity"), "sig", norm(F.col("sig"), 64).alias("norm_sig"))
    few = v.select("identity").distinct().limit(BROADCAST_SIGNATURES + 1).count() <= BROADCAST_SIGNATURES
    pairs = v.withColumn("norm_e", norm(F.col("e"), 64)).crossJoin(F.broadcast(s) if few else s)
    score = F.round(cosine(F.col("e"), F.col("sig"), 64, F.col("norm_e"), F.col("norm_sig")), 9)
    return pairs.select("vec_id", F.col("identity").alias("true_identity"), "claimed_identity", (F.col("identity") == F.col("claimed_identity")).cast("int").alias("label"), score.alias("score"))


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, score with many ties."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 101 / 100).alias("score"))
