"""Logical tables of the engine, as DDL, and the default configuration of a verifier."""

from __future__ import annotations

from dataclasses import asdict, dataclass

LANDMARK = "struct<x:double,y:double,z:double>"
VIDEOS = "video_id string, identity string, view string, is_augmented boolean, fps double, total_frames int, valid_frames int"
POSE_FRAMES = f"identity string, video_id string, frame_idx int, lm array<{LANDMARK}>"
FEATURE_FRAMES = "identity string, video_id string, frame_idx int, feat array<double>"
FEATURE_STATS = "dim int, mean double, std double"
SIGNATURES = "identity string, frame_idx int, sig array<double>, num_videos bigint"
PAIRS = "key string, true_identity string, claimed_identity string, label int"
SCORED_PAIRS = "key string, true_identity string, claimed_identity string, label int, score double"
HISTORY = "run string, epoch int, value double"
ATTRIBUTION = "sample_id string, frame_idx int, dim int, value double"


@dataclass(frozen=True)
class VerifierConfig:
    length: int = 60
    dims: int = 78
    hidden: int = 64
    threshold: float = 0.7737
    min_poses: int = 10
    min_videos: int = 1
    train_share: float = 0.8
    seed: str = "42"
    patience: int = 20
    min_delta: float = 0.001
    rate: float = 0.001
    rate_patience: int = 7

    def as_dict(self) -> dict:
        return asdict(self)
