"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi directly on its triangular factor.

Entries become whole numbers x (GRID steps a unit, shifted by OFFSET); the fit list holds each distinct x vector once, so hot
vectors weigh no more than others. Passes, all over rows in Arrow batches:

1. distinct vectors, packed to the fewest bytes an entry, by one exchange (copies are gone within tasks before);
2. their number n, sums S and extremes;
3. their scatter around whole numbers next to the means. Sums of whole numbers are exact in doubles as long as they stay below
   2^53, so the scatter does not depend on the order of tasks; what is left of the centring is exact in fractions;
4. on the driver, of d x d values: scatter = P'LL'P with L lower triangular by pivots, then rotations of pairs of columns of L
   until all are orthogonal; their norms are the singular values, the normalised columns the components;
5. the covariance of the whitened fit list, for the identity error; and a map over all rows for the result.

Tasks hand on one d x d matrix each, summed by Spark; the driver gets d x d values whatever the number of rows.

Defined cases: rows whose vector is null, or holds null or non-finite entries or one of 2^34 or more in size (whose steps
doubles would not tell apart), are dropped; so are rows of another number of entries than the longest vector has; equal
vectors and repeated rows get a row each; a null vec_id stays null; components are as many as the rank of the scatter (so
one distinct vector gives no rows); a deviation beyond a long is null; an empty table gives no rows; extra columns are
ignored, whatever their names. A component's sign is that of its entry of largest size (the first one), which is positive.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Steps a unit, the shift of x, components given out, entries' bound in steps.
GRID, OFFSET, COMPONENTS, BOUND = 64, 1_000_000, 16, 1 << 40
#: Share of the largest pivot below which the scatter has no further rank; cosine at which two columns count as orthogonal.
RANK, ORTHOGONAL, SWEEPS = 1e-14, 1e-15, 60
#: The least whole number whose square is no long.
ROOT = 3_037_000_500


def _steps(column):
    """Arrow list<double> column -> (indexes of rows that stay, int64 matrix of floor(GRID * c)) for each length of vector."""
    import numpy as np
    import pyarrow as pa

    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        flat = column.take(pa.array(at)).flatten()
        c = np.floor(GRID * flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, d)
        keep = (np.abs(c) < BOUND).all(axis=1)  # false for non-finite ones
        yield at[keep], c[keep].astype(np.int64)


def _pack(q) -> bytes:
    """A vector in the fewest bytes an entry that hold it; equal vectors have equal bytes."""
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        if ((small := q.astype(kind)) == q).all():
            return kind[-1].encode() + small.tobytes()
    raise AssertionError


def _unpack(keys):
    """Packed vectors of one length -> int64 matrix."""
    import numpy as np

    return np.stack([np.frombuffer(k, f"<i{k[:1].decode()}", offset=1).astype(np.int64) for k in keys])


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, vec array<double>."""
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))


def _packed(batches):
    import pyarrow as pa

    for batch in batches:
        for _, q in _steps(batch.column("vec")):
            keys = sorted({_pack(x) for x in q})
            yield pa.RecordBatch.from_arrays([pa.array([q.shape[1]] * len(keys), pa.int32()), pa.array(keys, pa.binary())], names=["d", "key"])


def fit_list(rows: DataFrame) -> DataFrame:
    """key: each distinct vector of the longest length once, packed; saved."""
    keys = saved(vectors(rows).select("vec").mapInArrow(_packed, "d int, key binary").groupBy("key").agg(F.max("d").alias("d")), "fit-vectors")
    d = keys.agg(F.max("d")).first()[0]
    return keys.where(F.col("d") == (d or 0)).select("key")


def _sums(batches):
    """The number, sums and extremes of each batch's vectors, a row an entry."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            q = _unpack(batch.column("key").to_pylist())
            d = q.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([len(q)] * d, pa.int64()), pa.array(q.sum(axis=0))], names=["i", "n", "s"])


def _products(weight, shift):
    """Task's sum of products of y = (q - shift) @ weight, and of y: rows (i, values); the sums of y have i = -1."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total, ones = 0, 0
        for batch in batches:
            if batch.num_rows:
                y = _centred(_unpack(batch.column("key").to_pylist()), shift)
                y = y if weight is None else y @ weight
                total, ones = total + y.T @ y, ones + y.sum(axis=0)
        if isinstance(total, int):
            return
        rows = [*total, ones]
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(total)), -1], pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["i", "row"])

    return run


def _centred(q, shift):
    """q - shift in doubles; shift: whole numbers and what is left of the means."""
    import numpy as np

    whole, rest = shift
    return (q - whole).astype(np.float64) - rest


def _summed(keys: DataFrame, weight, shift, d: int):
    """(sum of y y', sum of y) over all vectors, summed by Spark in pairs of entries."""
    import numpy as np

    parts = keys.mapInArrow(_products(weight, shift), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    got = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # d * (d + 1) values
    out = np.zeros((d + 1, d))
    for r in got:
        out[r.i, r.j] = r.v
    return out[:-1], out[-1]


def pivoted_cholesky(a):
    """L (d x rank, in the order of a's rows) with L L' = a, pivots by the largest diagonal entry left."""
    import numpy as np

    a = np.array(a, float)
    d, order = len(a), np.arange(len(a))
    low, first = np.zeros((d, d)), a.diagonal().max(initial=0)
    for k in range(d):
        left = a.diagonal()[k:] - (low[k:, :k] ** 2).sum(axis=1)
        p = k + int(left.argmax())
        if left[p - k] <= RANK * d * first or first <= 0:
            return low[np.argsort(order), :k]
        for x in (a, low, order):
            x[[k, p]] = x[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        low[k, k] = np.sqrt(left[p - k])
        low[k + 1 :, k] = (a[k + 1 :, k] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
    return low[np.argsort(order)]


def one_sided_jacobi(low):
    """(squared norms, normalised columns) of low after rotations that make its columns orthogonal, largest first."""
    import numpy as np

    cols = low.T.copy()
    for _ in range(SWEEPS):
        turned = False
        for p in range(len(cols) - 1):
            for q in range(p + 1, len(cols)):
                x, y = cols[p], cols[q]
                a, b, c = x @ x, y @ y, x @ y
                if abs(c) <= ORTHOGONAL * np.sqrt(a * b):
                    continue
                turned = True
                zeta = (b - a) / (2 * c)
                t = (1 if zeta >= 0 else -1) / (abs(zeta) + np.hypot(1, zeta))
                cs = 1 / np.hypot(1, t)
                cols[p], cols[q] = cs * x - cs * t * y, cs * t * x + cs * y
        if not turned:
            break
    norms = (cols**2).sum(axis=1)
    order = np.argsort(-norms, kind="stable")
    cols = cols[order] / np.sqrt(norms[order])[:, None]
    signs = np.sign(cols[np.arange(len(cols)), np.abs(cols).argmax(axis=1)])
    return norms[order], cols * signs[:, None]


class Whitening:
    """What the fit list gives: n, sums of steps, shift, components (rows), eigenvalues, trace, identity error."""

    def __init__(self, n, sums, shift, values, components, trace):
        import numpy as np

        self.n, self.sums, self.shift, self.values, self.trace = n, sums, shift, values, trace
        self.weight = components.T / np.sqrt(values)
        self.error = 0.0


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows' fit list; None where nothing varies."""
    import numpy as np

    keys = fit_list(rows)
    sums = keys.mapInArrow(_sums, "i int, n long, s long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)").alias(c)
    each = sorted(sums.groupBy("i").agg(exact("n"), exact("s")).collect(), key=lambda r: r.i)  # a row an entry
    if not each:
        return None
    n, s, d = int(each[0].n), [int(r.s) for r in each], len(each)
    whole = [round(Fraction(x, n)) for x in s]
    scatter, ones = _summed(keys, None, (np.array(whole, np.int64), np.zeros(d)), d)
    # scatter around the means: the sums of y are n times what the whole numbers leave, all exact in fractions
    left = [Fraction(x - n * w, n) for x, w in zip(s, whole)]
    cov = np.array([[float((Fraction(scatter[i, j]) - left[i] * left[j] * n) / n) for j in range(d)] for i in range(d)])
    low = pivoted_cholesky(cov)
    if not low.shape[1]:
        return None
    values, vecs = one_sided_jacobi(low)
    most = min(components, len(values))
    shift = (np.array(whole, np.int64), np.array([float(x) for x in left]))
    made = Whitening(n, s, shift, values[:most], vecs[:most], float(cov.trace()))
    product, one = _summed(keys, made.weight, shift, most)
    made.error = float(np.abs(product / n - np.outer(one / n, one / n) - np.eye(most)).max())
    return made


def _deviations(q, n: int, sums: list[int], whole):
    """Sum over entries of (n * q - S)^2, exact in longs; null beyond one. whole: whole numbers next to the means."""
    import numpy as np
    import pyarrow as pa

    y = q - whole
    rest = np.array([s - n * w for s, w in zip(sums, whole.tolist())], np.int64)
    over = np.abs(y).astype(np.float64) * n + np.abs(rest) >= 2.0**62
    z = np.where(over, ROOT, n * np.where(over, 0, y) - rest)
    over = (np.abs(z) >= ROOT).any(axis=1)
    square = np.where(over[:, None], 0, z) ** 2
    low, high = (square & 0xFFFFFFFF).sum(axis=1), (square >> 32).sum(axis=1)
    high += low >> 32
    over |= high >= 1 << 31
    return pa.array(np.where(over, 0, (high << 32) + (low & 0xFFFFFFFF)), mask=over)


def whitened(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that stays and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors(rows).limit(0).select("vec_id").mapInArrow(lambda batches: iter(()), schema)
    d, most = len(model.sums), len(model.values)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        explained = model.values / model.trace
        for batch in batches:
            for at, q in _steps(batch.column("vec")):
                if q.shape[1] != d or not len(q):
                    continue
                w = _centred(q, model.shift) @ model.weight
                k = len(q)
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, most)))
                far = _deviations(q, model.n, model.sums, model.shift[0]).take(pa.array(np.repeat(np.arange(k), most)))
                columns = [ids, pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), k)), pa.array(np.full(k * most, model.n)), far, pa.array(w.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * most, model.error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors(rows).mapInArrow(run, schema)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, embedding) whitened by the components of their own distinct vectors."""
    return whitened(rows, fit(rows, components))
