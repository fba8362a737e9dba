"""Leave-one-person-out and variant training in one pass over the rows, by sums of products less a fold's own.

The classifier is ridge regression on labels of -1 and 1, whose fit only needs the sums A = sum of z z' and b = sum of z y over
rows z = (x, 1). A fold that leaves a person out has the totals less the person's own sums, a variant has a submatrix of the
totals; so neither reads the rows again, and nothing grows with people but a row of weights for each. Totals are d x d
values, summed by Spark. A person's rows meet in one task, which solves for the fold's weights; a person of more than `hot`
rows is dealt to several, whose sums are added before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalty a row, and rows of a person that one task sums.
RIDGE, HOT = 0.01, 50_000
SCORED = "key string, true_identity string, claimed_identity string, label int, score double"


def _products(x, label):
    """Sums of products of (x, 1, y) over the rows of x."""
    import numpy as np

    z = np.hstack([x, np.ones((len(x), 1)), (2.0 * label - 1)[:, None]])
    return z.T @ z


def solved(sums, rows: float, ridge: float = RIDGE, columns=None):
    """Weights (with the intercept last) of the ridge regression that these sums belong to; of some columns only, if given."""
    import numpy as np

    d = len(sums) - 2
    own = np.append(np.arange(d) if columns is None else np.asarray(columns), d)
    penalty = np.full(len(own), ridge * rows)
    penalty[-1] = 1e-9 * rows
    return np.linalg.solve(sums[np.ix_(own, own)] + np.diag(penalty), sums[own, -1])


def _values(column, d: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def totals(rows: DataFrame, d: int):
    """Sums of products over all rows (x, label): d + 2 rows of d + 2 values."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros((d + 2, d + 2))
        for batch in batches:
            if batch.num_rows:
                total += _products(_values(batch.column("x"), d), batch.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 2), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    def added(batches):
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row")):
                total[i] = total.get(i, 0) + row.values.to_numpy(zero_copy_only=False)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["i", "row"])

    schema = "i int, row array<double>"
    got = rows.select("x", "label").mapInArrow(run, schema).repartition("i").mapInArrow(added, schema).collect()  # d + 2 rows
    out = np.zeros((d + 2, d + 2))
    for r in got:
        out[r.i] = r.row
    return out


def fold_weights(rows: DataFrame, d: int, ridge: float = RIDGE, hot: int = HOT) -> DataFrame:
    """person, w: weights of a fit on all rows (true_identity, claimed_identity, label, x) that have no part of the person."""
    import numpy as np

    whole = totals(rows, d)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.explode(F.array_distinct(F.array("true_identity", "claimed_identity"))).alias("person"), "key", "label", "x")
    pieces = own.groupBy("person").agg(F.ceil(F.count("*") / hot).alias("pieces"))
    own = own.join(pieces, "person").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")))
    own = own.repartition(parts, "person", "piece").sortWithinPartitions("person", "piece").select("person", "piece", "pieces", "label", "x")

    def weights(sums):
        left = whole - sums
        return solved(left, left[d, d], ridge)

    def run(batches):
        import pyarrow as pa

        at, total, pieces = None, None, 1

        def out():
            values = weights(total) if pieces == 1 else total.ravel()
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([pieces > 1]), pa.array([values.tolist()], pa.list_(pa.float64()))], names=["person", "partial", "w"])

        for batch in batches:
            names = list(zip(batch.column("person").to_pylist(), batch.column("piece").to_pylist()))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if names[a] != at:
                    if at is not None:
                        yield out()
                    at, total, pieces = names[a], np.zeros((d + 2, d + 2)), batch.column("pieces")[a].as_py()
                part = batch.slice(a, b - a)
                total += _products(_values(part.column("x"), d), part.column("label").to_numpy())
        if at is not None:
            yield out()

    def joined(key, table):
        import pyarrow as pa

        sums = sum(v.values.to_numpy(zero_copy_only=False) for v in table.column("w")).reshape(d + 2, d + 2)
        return pa.table({"person": pa.array([key[0].as_py()], pa.string()), "w": pa.array([weights(sums).tolist()], pa.list_(pa.float64()))})

    found = own.mapInArrow(run, "person string, partial boolean, w array<double>")
    large = found.where("partial").groupBy("person").applyInArrow(joined, "person string, w array<double>")
    return found.where("not partial").select("person", "w").union(large)


def linear(x, w, d: int):
    """Score between 0 and 1 of features x by weights w with the intercept last."""
    s = F.aggregate(F.zip_with(x, F.slice(w, 1, d), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) + F.get(w, F.lit(d))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s + 1) / 2))


def leave_one_out(rows: DataFrame, d: int, ridge: float = RIDGE, hot: int = HOT) -> DataFrame:
    """test_person, key, true_identity, claimed_identity, label, score: each probe by a fit without its person."""
    w = fold_weights(rows, d, ridge, hot).withColumnRenamed("person", "test_person")
    both = rows.join(w, rows.true_identity == w.test_person)
    return both.select("test_person", "key", "true_identity", "claimed_identity", "label", linear(F.col("x"), F.col("w"), d).alias("score"))


def variants(rows: DataFrame, d: int, columns: dict[str, list[int]], ridge: float = RIDGE) -> DataFrame:
    """variant, key, true_identity, claimed_identity, label, score: all variants (names of columns of x) from one pass."""
    whole = totals(rows, d)
    scores = []
    for name, own in columns.items():  # a few, known ones
        w = solved(whole, whole[d, d], ridge, own)
        x = F.transform(F.array(*map(F.lit, own)), lambda i: F.get("x", i))
        scores.append(F.struct(F.lit(name).alias("variant"), linear(x, F.array(*[F.lit(float(v)) for v in w]), len(own)).alias("score")))
    return rows.select("key", "true_identity", "claimed_identity", "label", F.explode(F.array(*scores)).alias("s")).select("s.variant", "key", "true_identity", "claimed_identity", "label", "s.score")
