"""Column functions on body landmarks and vectors. Slots: 0,1 shoulders; 2,3 hips; 4,5 knees; 6,7 ankles; 8,9 heels; 10,11 toes; left first."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

N_SLOTS, N_DIMS, EPS = 12, 78, 1e-8
#: Joints whose angle is taken, as (one end, the joint, other end) by slot.
ANGLES = {"left_knee": (2, 4, 6), "right_knee": (3, 5, 7), "left_hip": (0, 2, 4), "right_hip": (1, 3, 5), "left_ankle": (4, 6, 10), "right_ankle": (5, 7, 11)}
#: Slots joined by a bone.
BONES = ((0, 1), (0, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 6), (5, 7), (6, 8), (7, 9), (6, 10), (7, 11))
PAIRS = tuple((i, i + 1) for i in range(0, N_SLOTS, 2))


def total(columns) -> Column:
    """Sum of a fixed list of columns, as one generated expression."""
    return reduce(add, columns)


def dot(a: Column, b: Column, n: int) -> Column:
    """Product sum of arrays of n elements: written out where short; else as a fold, as long methods are not compiled."""
    if n <= 12:
        return total(a[i] * b[i] for i in range(n))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, n: int) -> Column:
    return F.sqrt(dot(a, a, n))


def cosine(a: Column, b: Column, n: int, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine with EPS in the denominator; norms that were taken before a join need not be taken for every pair."""
    return dot(a, b, n) / ((norm(a, n) if norm_a is None else norm_a) * (norm(b, n) if norm_b is None else norm_b) + EPS)


def euclidean(a: Column, b: Column, n: int) -> Column:
    """Distance of the directions of two vectors, with EPS under the root."""
    na, nb = F.greatest(norm(a, n), F.lit(1e-12)), F.greatest(norm(b, n), F.lit(1e-12))
    gaps = F.zip_with(a, b, lambda x, y: (x / na - y / nb) * (x / na - y / nb))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) + EPS)


def distance(a: Column, b: Column, axes: str = "xy") -> Column:
    return F.sqrt(total((a[k] - b[k]) * (a[k] - b[k]) for k in axes))


def hip_centre(lm: Column) -> dict[str, Column]:
    return {k: (lm[2][k] + lm[3][k]) / 2 for k in "xyz"}


def hip_centred(lm: Column) -> Column:
    """Array of the 12 slots as x, y, z in a row, less the middle of the hips."""
    c = hip_centre(lm)
    return F.array(*[lm[j][k] - c[k] for j in range(N_SLOTS) for k in "xyz"])


def joint_angle(a: Column, b: Column, c: Column) -> Column:
    """Degrees at b between a and c, in the image plane."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    cos = (ux * vx + uy * vy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy) + EPS)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def joint_angles(lm: Column) -> Column:
    return F.array(*[joint_angle(lm[a], lm[b], lm[c]) for a, b, c in ANGLES.values()])


def step_width(lm: Column) -> Column:
    return distance(lm[6], lm[7])


def symmetry(coords: Column) -> Column:
    """Mean of |left x + right x| over the six pairs of hip-centred slots."""
    return total(F.abs(coords[3 * a] + coords[3 * b]) for a, b in PAIRS) / len(PAIRS)


def torso(coords: Column, mode: str = "shoulder_ankle") -> Column:
    """Scale of the key-point test: middle of shoulders to middle of ankles (or of hips), at least 1e-6."""
    low = {"shoulder_ankle": (6, 7), "shoulder_hip": (2, 3)}[mode]
    gap = [(coords[k] + coords[3 + k]) / 2 - (coords[3 * low[0] + k] + coords[3 * low[1] + k]) / 2 for k in range(3)]
    return F.greatest(F.sqrt(total(g * g for g in gap)), F.lit(1e-6))


def face_box(lm: Column, nose: Column, width: int, height: int) -> Column:
    """struct of left, top, right, bottom: a box about the nose that the shoulders' distance scales."""
    r = F.greatest((F.lit(0.45) * F.abs(lm[0]["x"] - lm[1]["x"]) * width).cast("int"), F.lit(30))
    cx, cy = (nose["x"] * width).cast("int"), (nose["y"] * height).cast("int")
    edge = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most), v.cast("int")))
    return F.struct(edge(cx - r, width).alias("left"), edge(cy - r * 1.3, height).alias("top"), edge(cx + r, width).alias("right"), edge(cy + r * 0.5, height).alias("bottom"))


def softmax(logits: Column, n: int) -> Column:
    top = F.array_max(logits)
    parts = [F.exp(logits[i] - top) for i in range(n)]
    return F.array(*[p / total(parts) for p in parts])


def triplet_loss(a: Column, p: Column, n: Column, dims: int, margin: float = 1.0) -> Column:
    """relu(d(a,p) - d(a,n) + margin) on squared distances of unit vectors, each 2 - 2 cos."""
    size = lambda v: F.greatest(F.sqrt(dot(v, v, dims)), F.lit(1e-12))
    far = lambda u, v: 2 - 2 * dot(u, v, dims) / (size(u) * size(v))
    return F.greatest(F.lit(0.0), far(a, p) - far(a, n) + margin)


def contrastive_loss(a: Column, b: Column, same: Column, dims: int, margin: float = 2.0) -> Column:
    d2 = total((a[i] - b[i]) * (a[i] - b[i]) for i in range(dims))
    open_ = F.greatest(F.lit(0.0), margin - F.sqrt(d2))
    return F.when(same, d2).otherwise(open_ * open_)


def verdict(best_score: Column, best_identity: Column, claimed: Column, own_score: Column, threshold: float = 0.7737) -> Column:
    """AUTHENTIC where the claim's own score is over the threshold; else IDENTITY_MISMATCH where another's is; else SUSPECTED_FAKE."""
    return F.when(own_score > threshold, "AUTHENTIC").when((best_score > threshold) & (best_identity != claimed), "IDENTITY_MISMATCH").otherwise("SUSPECTED_FAKE")
