"""One-to-many search: the k enrolled vectors of largest cosine for each probe, without forming pairs.

Up to `few` enrolled vectors travel with the tasks; each batch of probes is one matrix product a block of them. Beyond that,
enrolled vectors and probes are dealt to the nearest of PIVOTS pivots and packed into blocks of one pivot, a row a block, with
the largest angle to the pivot. Each block of probes is first compared with the blocks of its own pivot. That gives every
probe a k-th best score, and a block whose pivot is too far away, by the triangle inequality of angles, to hold a better one
for any probe of a block is skipped. The other blocks meet by an equality join on the block's number. A probe keeps k rows a
block that it meets, so nothing is written for each pair.

Defined cases: scores are rounded to 9 digits; of equal ones the first by name is better, or the last with `last_name`; a
vector of length zero scores 0 with all; null vectors are left out; fewer than k enrolled vectors give as many rows; without
enrolled vectors there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a block, enrolled rows that travel with the tasks, pivots.
BLOCK, FEW, PIVOTS = 2048, 20_000, 64
SCORED = "key string, claimed_identity string, score double"


def _matrix(column, dims: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _scores(e, sig):
    """Rounded cosines of the rows of two matrices."""
    import numpy as np

    lengths = np.linalg.norm(e, axis=1)[:, None] * np.linalg.norm(sig, axis=1)[None]
    return np.round(e @ sig.T / (lengths + 1e-8), 9)


def _best(scores, k: int):
    """(row, column) of the k largest of each row, of equal ones the first; columns are in order of preference."""
    import numpy as np

    k = min(k, scores.shape[1])
    if k == 1:
        return np.arange(len(scores)), scores.argmax(axis=1)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(scores)), k), order.ravel()


def _rows(keys, names, scores, at, to):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), names.take(pa.array(to)), pa.array(scores[at, to])], names=["key", "claimed_identity", "score"])


def _in_tasks(names: list[str], sig, k: int, dims: int):
    """Probes against vectors that are here, block after block, with the best k so far."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = pa.array(names)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                e, best, at = _matrix(part.column("e"), dims), None, None
                for lo in range(0, len(sig), BLOCK):
                    scores = _scores(e, sig[lo : lo + BLOCK])
                    place = np.broadcast_to(np.arange(lo, lo + scores.shape[1]), scores.shape)
                    if best is not None:
                        scores, place = np.hstack([best, scores]), np.hstack([at, place])
                    i, j = _best(scores, k)
                    best, at = scores[i, j].reshape(len(e), -1), place[i, j].reshape(len(e), -1)
                key = part.column("key").take(pa.array(np.repeat(np.arange(len(e)), best.shape[1])))
                yield pa.RecordBatch.from_arrays([key, held.take(pa.array(at.ravel())), pa.array(best.ravel())], names=["key", "claimed_identity", "score"])

    return run


def _unit(m):
    import numpy as np

    length = np.linalg.norm(m, axis=1)
    return m / np.where(length > 0, length, 1)[:, None], length == 0


def _cells(pivots, dims: int):
    """name, e -> cell (nearest pivot), away (angle to it; pi for a vector of length zero, which is never skipped), name, e."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            unit, zero = _unit(_matrix(batch.column("e"), dims))
            near = unit @ pivots.T
            cell = near.argmax(axis=1)
            away = np.where(zero, np.pi, np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(away), batch.column("name"), batch.column("e")], names=["cell", "away", "name", "e"])

    return run


def _packed(most: int):
    """Rows in order of cell -> blocks of at most `most` rows of one cell: block, cell, reach, names, m (rows one after the other)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number, held, cell = TaskContext.get().partitionId() << 32, [], None

        def out():
            nonlocal number
            number += 1
            t = pa.Table.from_batches(held)
            reach, names = float(np.max(t.column("away").to_numpy())), t.column("name").to_pylist()
            values = t.column("e").combine_chunks().flatten()
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((number, cell, reach, names, values.to_pylist()), kinds)], names=["block", "cell", "reach", "names", "m"])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    if held and (cells[a] != cell or sum(x.num_rows for x in held) == most):
                        yield out()
                        held = []
                    cell = int(cells[a])
                    room = min(b - a, most - sum(x.num_rows for x in held))
                    held.append(batch.slice(a, room))
                    a += room
        if held:
            yield out()

    return run


def _blocks(rows: DataFrame, pivots, dims: int, name: str) -> DataFrame:
    """rows (name, e) as blocks; a hot cell is dealt to 16 tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(_cells(pivots, dims), "cell int, away double, name string, e array<double>")
    dealt = dealt.repartition(parts, "cell", F.pmod(F.xxhash64("name"), F.lit(16))).sortWithinPartitions("cell", "name")
    return written(dealt.mapInArrow(_packed(BLOCK), "block long, cell int, reach double, names array<string>, m array<double>"), name)


def _compared(k: int, dims: int, last_name: bool):
    """Rows of a probes' block (names, m) and an enrolled one (their_names, their_m) -> the k best of each probe."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                keys, names, e, sig = (batch.column(c)[i].values for c in ("names", "their_names", "m", "their_m"))
                sig = sig.to_numpy().reshape(-1, dims)
                order = np.argsort(np.array(names.to_pylist(), object), kind="stable")
                order = order[::-1] if last_name else order
                scores = _scores(e.to_numpy().reshape(-1, dims), sig[order])
                yield _rows(keys, names.take(pa.array(order)), scores, *_best(scores, k))

    return run


def _reached(pivots, ends: list[tuple[int, int, float]]):
    """Blocks of probes with their least k-th score (least) -> block, other: the enrolled blocks that may hold a better one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        others, cells, reach = (np.array(x) for x in zip(*ends))
        angle = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
        for batch in batches:
            found = []
            for block, cell, own, least in zip(*[batch.column(c).to_pylist() for c in ("block", "cell", "reach", "least")]):
                near = np.maximum(0, angle[cell, cells] - own - reach)
                # below a right angle a score is at most the cosine; beyond it short vectors come close to 0
                most = np.where(near < np.pi / 2, np.cos(near), 0) + 1e-6
                found += [(block, int(o)) for o in others[(cells != cell) & (most >= (-2.0 if least is None else least))]]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["block", "other"])

    return run


def best_matches(probes: DataFrame, enrolled: DataFrame, k: int, dims: int, last_name: bool = False, few: int = FEW, pivots: int = PIVOTS) -> DataFrame:
    """key, claimed_identity, score of the k best of enrolled (identity, sig) for each of probes (key, e)."""
    kind = dict(probes.dtypes)["key"]
    found = _found(probes, enrolled, k, dims, last_name, few, pivots)
    return found if kind == "string" else found.withColumn("key", F.col("key").cast(kind))


def _found(probes: DataFrame, enrolled: DataFrame, k: int, dims: int, last_name: bool, few: int, pivots: int) -> DataFrame:
    import numpy as np

    probes = probes.select(F.col("key").cast("string").alias("key"), "e").where("e is not null")
    enrolled = enrolled.select("identity", "sig").where("sig is not null")
    head = enrolled.orderBy(F.desc("identity") if last_name else F.asc("identity")).limit(few + 1).collect()  # bounded
    if not head:
        return probes.where("false").select("key", F.lit("").alias("claimed_identity"), F.lit(0.0).alias("score"))
    if len(head) <= few:
        return probes.mapInArrow(_in_tasks([r.identity for r in head], np.array([r.sig for r in head], float), k, dims), SCORED)

    chosen = enrolled.orderBy(F.xxhash64("identity"), "identity").limit(pivots).collect()
    points, _ = _unit(np.array([r.sig for r in chosen], float))
    own = _blocks(probes.select(F.col("key").alias("name"), "e"), points, dims, "probes")
    theirs = _blocks(enrolled.select(F.col("identity").alias("name"), F.col("sig").alias("e")), points, dims, "enrolled")
    other = theirs.select(F.col("block").alias("other"), F.col("cell").alias("their_cell"), F.col("names").alias("their_names"), F.col("m").alias("their_m"))
    compare = lambda df: df.select("names", "m", "their_names", "their_m").mapInArrow(_compared(k, dims, last_name), SCORED)
    near = written(compare(own.join(other, own.cell == other.their_cell)), "near-scores")

    # the k-th best so far of each probe, and the least of a block; a probe with fewer than k is open to all
    keys = own.select("block", F.explode("names").alias("key"))
    kth = near.groupBy("key").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("key", F.get("s", F.lit(k - 1)).alias("kth"))
    least = keys.join(kth, "key", "left").groupBy("block").agg(F.when(F.count("*") == F.count("kth"), F.min("kth")).alias("least"))
    ends = [(r.block, r.cell, r.reach) for r in theirs.select("block", "cell", "reach").toLocalIterator()]  # a row a block
    reached = own.select("block", "cell", "reach").join(least, "block").mapInArrow(_reached(points, ends), "block long, other long")
    far = compare(reached.join(own.select("block", "names", "m"), "block").join(other.drop("their_cell"), "other"))
    every = near.unionByName(far)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.desc("claimed_identity") if last_name else F.asc("claimed_identity")))
    return every.withColumn("place", place).where(F.col("place") <= k).drop("place")
