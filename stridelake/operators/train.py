"""Training of a verifier on time-pooled comparison features: a distributed logistic regression.

A plain verifier beside the head (descent.py trains that one); its figures are its own. Folds and variants are in folds.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .enroll import comparison_features

#: Which of the 78 dimensions a variant sees.
VARIANTS = {"coords": range(36), "angles": range(36, 42), "velocities": range(42, 78), "all": range(78)}


def pair_features(pairs: DataFrame, videos: DataFrame, signatures: DataFrame, dims=range(78)) -> DataFrame:
    """key, true_identity, claimed_identity, label, x: comparison features of a pooled video and a pooled signature."""
    of = lambda c: F.array(*[F.col(c)[i] for i in dims])
    p = pairs.join(videos.select(F.col("video_id").alias("key"), F.col("feat").alias("_v")), "key")
    p = p.join(signatures.select(F.col("identity").alias("claimed_identity"), F.col("sig").alias("_s")), "claimed_identity")
    return p.select("key", "true_identity", "claimed_identity", "label", comparison_features(of("_v"), of("_s")).alias("x"))


def fit(rows: DataFrame, ridge: float = 0.01, rounds: int = 20):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    train = rows.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    return LogisticRegression(maxIter=rounds, regParam=ridge).fit(train)


def score(model, rows: DataFrame) -> DataFrame:
    """The model's probabilities as a column expression of its coefficients."""
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    logit = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(float(model.intercept)), lambda t, v: t + v)
    return rows.select("key", "true_identity", "claimed_identity", "label", (1 / (1 + F.exp(-logit))).alias("score"))
