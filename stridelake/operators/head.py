"""The verification head: three convolutions over the comparison features of two sequences, mean over time, two layers.

Only this part of the model decides a verdict. It runs in NumPy on Arrow batches of pairs; weights travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

LENGTH, DIMS, HIDDEN = 60, 78, 64
PAIR = "pair_id string, video array<double>, claimed array<double>"
SCORED = "pair_id string, p_authentic double, confidence double, prediction int"


def initial_weights(seed: int = 42, hidden: int = HIDDEN, dims: int = DIMS) -> dict:
    """Random weights of the head: convolutions of 7, 5 and 3 frames, each with a batch norm, then two dense layers."""
    import numpy as np

    rng, half = np.random.default_rng(seed), hidden // 2
    w = {}
    for i, (n_in, n_out, k) in enumerate(((3 * dims, hidden, 7), (hidden, hidden, 5), (hidden, half, 3))):
        w[f"conv{i}"] = rng.normal(0, (2 / (n_in * k)) ** 0.5, (n_out, n_in, k))
        w[f"bias{i}"] = np.zeros(n_out)
        w[f"scale{i}"], w[f"shift{i}"], w[f"mean{i}"], w[f"var{i}"] = np.ones(n_out), np.zeros(n_out), np.zeros(n_out), np.ones(n_out)
    for name, n_in, n_out in (("dense0", half, half), ("dense1", half, 2)):
        w[name] = rng.normal(0, (2 / (n_in + n_out)) ** 0.5, (n_out, n_in))
        w[f"{name}_bias"] = np.zeros(n_out)
    return w


def trainable(weights: dict) -> int:
    """Number of trained values: all but the running means and variances."""
    return sum(v.size for k, v in weights.items() if not k.startswith(("mean", "var")))


def forward(weights: dict, video, claimed):
    """Logits (n, 2) of sequences (n, length, dims)."""
    import numpy as np

    gap = video - claimed
    x = np.concatenate([gap, np.abs(gap), video * claimed], axis=2)
    for i in range(3):
        conv = weights[f"conv{i}"]
        k = conv.shape[2]
        padded = np.pad(x, ((0, 0), (k // 2, k // 2), (0, 0)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, k, axis=1)  # n, length, channels, k
        x = np.einsum("ntck,ock->nto", windows, conv, optimize=True) + weights[f"bias{i}"]
        x = (x - weights[f"mean{i}"]) / np.sqrt(weights[f"var{i}"] + 1e-5) * weights[f"scale{i}"] + weights[f"shift{i}"]
        x = np.maximum(x, 0)
    x = np.maximum(x.mean(axis=1) @ weights["dense0"].T + weights["dense0_bias"], 0)
    return x @ weights["dense1"].T + weights["dense1_bias"]


def score_pairs(pairs: DataFrame, weights: dict, length: int = LENGTH, dims: int = DIMS, threshold: float = 0.7737) -> DataFrame:
    """SCORED rows of PAIR rows (both sequences flat, frame by frame); authentic only over the threshold."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                video, claimed = (np.stack(part[c].to_numpy()).astype(np.float32).reshape(-1, length, dims) for c in ("video", "claimed"))
                logits = forward(weights, video, claimed)
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pd.DataFrame({"pair_id": part["pair_id"], "p_authentic": p[:, 1].astype(float), "confidence": p.max(axis=1).astype(float), "prediction": (p[:, 1] > threshold).astype("int32")})

    return pairs.select("pair_id", "video", "claimed").mapInPandas(run, SCORED)
