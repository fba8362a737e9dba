"""Gradients of the verification head: with respect to its input (attributions) and to its weights (training steps).

Reverse mode through the two dense layers, the mean over time, and three times rectifier, norm and convolution, in NumPy on
Arrow batches of pairs. Norms use their running values, as they do when the head scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .head import DIMS, LENGTH

#: Pairs that are worked on at once, and values of a gradient that go in one row.
PART, CHUNK, EPS = 32, 4096, 1e-5


def _padded(x, k: int):
    """Windows (n, length, channels, k) of x around each frame, zeros beyond its ends."""
    import numpy as np

    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (k // 2, k // 2), (0, 0))), k, axis=1)


def forward(w: dict, video, claimed):
    """Logits (n, 2), and what backward() needs of the way there."""
    import numpy as np

    gap, layers = video - claimed, []
    x = np.concatenate([gap, np.abs(gap), video * claimed], axis=2)
    for i in range(3):
        windows = _padded(x, w[f"conv{i}"].shape[2])
        z = np.einsum("ntck,ock->nto", windows, w[f"conv{i}"], optimize=True) + w[f"bias{i}"]
        unit = (z - w[f"mean{i}"]) / np.sqrt(w[f"var{i}"] + EPS)
        y = unit * w[f"scale{i}"] + w[f"shift{i}"]
        layers.append((windows, unit, y > 0))
        x = np.maximum(y, 0)
    pooled = x.mean(axis=1)
    hidden = np.maximum(pooled @ w["dense0"].T + w["dense0_bias"], 0)
    return hidden @ w["dense1"].T + w["dense1_bias"], (video, claimed, layers, pooled, hidden)


def backward(w: dict, way, slope):
    """(gradient of each weight, summed over pairs; gradient of video) for the slope (n, 2) of the logits."""
    import numpy as np

    video, claimed, layers, pooled, hidden = way
    grads = {"dense1": slope.T @ hidden, "dense1_bias": slope.sum(axis=0)}
    d = (slope @ w["dense1"]) * (hidden > 0)
    grads |= {"dense0": d.T @ pooled, "dense0_bias": d.sum(axis=0)}
    d = d @ w["dense0"]
    d = np.repeat(d[:, None] / video.shape[1], video.shape[1], axis=1)
    for i in (2, 1, 0):
        windows, unit, open_ = layers[i]
        d = d * open_
        grads |= {f"scale{i}": (d * unit).sum(axis=(0, 1)), f"shift{i}": d.sum(axis=(0, 1))}
        d = d * (w[f"scale{i}"] / np.sqrt(w[f"var{i}"] + EPS))
        conv = w[f"conv{i}"]
        grads |= {f"bias{i}": d.sum(axis=(0, 1)), f"conv{i}": np.einsum("nto,ntck->ock", d, windows, optimize=True)}
        d = np.einsum("ntok,ock->ntc", _padded(d, conv.shape[2]), conv[:, :, ::-1], optimize=True)
    dims = video.shape[2]
    gap = video - claimed
    return grads, d[:, :, :dims] + np.sign(gap) * d[:, :, dims : 2 * dims] + claimed * d[:, :, 2 * dims :]


def softmax(logits):
    import numpy as np

    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def sequences(batch, length: int, dims: int):
    """(slice of the batch, video, claimed) of at most PART pairs at once."""
    import numpy as np

    for at in range(0, batch.num_rows, PART):
        part = batch.slice(at, PART)
        yield part, *(part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length, dims) for c in ("video", "claimed"))


def attribute(pairs: DataFrame, weights: dict, target: int | None = None, length: int = LENGTH, dims: int = DIMS) -> DataFrame:
    """sample_id, frame_idx, dim, value = |x| |d logit / d x| of the video of pairs (pair_id, video, claimed).

    The logit is that of `target`, else of the class that the head predicts. A pair has length * dims rows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, video, claimed in sequences(batch, length, dims):
                logits, way = forward(weights, video, claimed)
                slope = np.eye(2)[logits.argmax(axis=1) if target is None else np.full(len(video), target)]
                value = np.abs(video) * np.abs(backward(weights, way, slope)[1])
                n, each = len(video), length * dims
                columns = [part.column("pair_id").take(pa.array(np.repeat(np.arange(n), each))), pa.array(np.tile(np.repeat(np.arange(length, dtype=np.int32), dims), n)), pa.array(np.tile(np.arange(dims, dtype=np.int32), n * length)), pa.array(value.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["sample_id", "frame_idx", "dim", "value"])

    return pairs.select("pair_id", "video", "claimed").mapInArrow(run, "sample_id string, frame_idx int, dim int, value double")


def trained(weights: dict) -> list[str]:
    """Names of the trained weights, in the order of a flat gradient (that of names, so that read weights have the same)."""
    return sorted(k for k in weights if not k.startswith(("mean", "var")))


def flat(values: dict, names: list[str]):
    import numpy as np

    return np.concatenate([np.ravel(values[k]) for k in names])


def loss_and_gradient(pairs: DataFrame, weights: dict, length: int = LENGTH, dims: int = DIMS, gradient: bool = True):
    """(pairs, mean cross-entropy, share predicted right, flat mean gradient) over pairs (label, video, claimed).

    Each task sums its pairs' gradients and hands them on in chunks; Spark sums each chunk over tasks, in one row for all of
    them at any time. The driver gets one gradient, of as many values as the head has weights.
    """
    import numpy as np

    names = trained(weights)

    def run(batches):
        import pyarrow as pa

        total, sums = 0.0, np.zeros(3)
        for batch in batches:
            for part, video, claimed in sequences(batch, length, dims):
                label = part.column("label").to_numpy()
                logits, way = forward(weights, video, claimed)
                p, n = softmax(logits), np.arange(len(label))
                sums += (len(label), -np.log(np.maximum(p[n, label], 1e-300)).sum(), (logits.argmax(axis=1) == label).sum())
                if gradient:
                    slope = p.copy()
                    slope[n, label] -= 1
                    total = total + flat(backward(weights, way, slope)[0], names)
        rows = [(-1, sums)] + ([(i, total[i * CHUNK : (i + 1) * CHUNK]) for i in range(-(-len(total) // CHUNK))] if not isinstance(total, float) else [])
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float64()))], names=["chunk", "part"])

    def added(batches):
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for k, v in zip(batch.column("chunk").to_pylist(), batch.column("part")):
                total[k] = total.get(k, 0) + v.values.to_numpy(zero_copy_only=False)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["chunk", "part"])

    schema = "chunk int, part array<double>"
    parts = pairs.select("label", "video", "claimed").mapInArrow(run, schema).repartition("chunk").mapInArrow(added, schema)
    found = {r.chunk: np.array(r.part) for r in parts.collect()}  # one gradient
    n, loss, right = found.pop(-1, np.zeros(3))
    if not n:
        return 0, 0.0, 0.0, None
    return int(n), loss / n, right / n, np.concatenate([found[k] for k in sorted(found)]) / n if found else None
