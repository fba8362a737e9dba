"""Verification of claims against enrolled signatures: one-to-one, one-to-many, and the three-way verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cosine, verdict
from .enroll import require_enrolled
from .search import best_matches

def verify_claims(claims: DataFrame, signatures: DataFrame, dims: int, threshold: float = 0.7737) -> DataFrame:
    """key, claimed_identity, score, is_authentic of claims (key, claimed_identity, e); an unenrolled claim is an error."""
    s = signatures.select(F.col("identity").alias("claimed_identity"), "sig")
    both = require_enrolled(claims, signatures).join(s, "claimed_identity")
    score = cosine(F.col("e"), F.col("sig"), dims)
    return both.select("key", "claimed_identity", score.alias("score")).withColumn("is_authentic", F.col("score") > threshold)


def identify(probes: DataFrame, signatures: DataFrame, dims: int) -> DataFrame:
    """key, best_identity, best_score of probes (key, e): the best of all enrolled identities, of equal ones the last by name."""
    best = best_matches(probes, signatures, 1, dims, last_name=True)
    return best.select("key", F.col("claimed_identity").alias("best_identity"), F.col("score").alias("best_score"))


def verdicts(claims: DataFrame, signatures: DataFrame, dims: int, threshold: float = 0.7737) -> DataFrame:
    """key, claimed_identity, score, best_identity, best_score, verdict of claims."""
    own = verify_claims(claims, signatures, dims, threshold)
    all_ = own.join(identify(claims.select("key", "e"), signatures, dims), "key")
    return all_.select("key", "claimed_identity", "score", "best_identity", "best_score", verdict(F.col("best_score"), F.col("best_identity"), F.col("claimed_identity"), F.col("score"), threshold).alias("verdict"))
