"""Whitening against eigenvectors of the covariance, exact deviations, and edge cases."""

import numpy as np
import pytest

from stridelake.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, most=16):
    """(vec_id, n, deviation), whitened, explained of the rows that stay, from numpy's eigenvectors."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    most = min(most, int((values > 1e-9 * values[0]).sum()))
    deviations = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))) for row in x]
    return n, deviations, (x - s / n) @ vecs[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()


def compared(got, rows):
    n, deviations, white, explained = plain(rows)
    most = len(explained)
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [(i, k + 1, n, d) for (i, _), d in sorted(zip(rows, deviations), key=lambda x: x[0][0]) for k in range(most)]
    w = np.array([r.whitened for r in got]).reshape(-1, most)
    white = white[np.argsort([i for i, _ in rows], kind="stable")]
    signs = np.sign((w * white).sum(axis=0))
    assert np.abs(w - white * signs).max() < 1e-8
    assert np.allclose([r.explained for r in got[:most]], explained, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compared(queries.op11_embedding_whitening(spark, SF).collect(), rows)


def test_hot_copies_weigh_once_and_bad_rows_go(spark):
    rng = np.random.default_rng(5)
    scales = np.array([3.0, 2.0, 1.2, 0.8, 0.5, 300.0])
    good = [(i, (rng.normal(size=6) * scales).tolist()) for i in range(120)]
    good += [(200 + i, good[0][1]) for i in range(90)]
    bad = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (1004, [1.0, 2.0]), (1005, []), (1006, [1e300, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([*good, *bad], SCHEMA).selectExpr("*", "1 AS key", "2 AS vec", "3 AS i", "4 AS row")
    got = whitening.whiten(df.repartition(5)).collect()
    assert {r.n for r in got} == {120}
    compared(got, good)


def test_sums_do_not_depend_on_the_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, other = (whitening.fit(df.repartition(k)) for k in (1, 7))
    assert (one.weight == other.weight).all() and (one.values == other.values).all() and one.sums == other.sums


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_varies(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_components_where_entries_depend_on_each_other(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [a, b, a + b, a]) for i, (a, b) in enumerate((rng.integers(-50, 50, (60, 2)) / 64).tolist())]
    compared(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_factors():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(12, 30))
    a = a @ a.T
    low = whitening.pivoted_cholesky(a)
    assert np.allclose(low @ low.T, a)
    values, vecs = whitening.one_sided_jacobi(low)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12)
    assert np.allclose(vecs @ vecs.T, np.eye(12), atol=1e-13) and np.allclose(vecs.T @ np.diag(values) @ vecs, a)


def test_deviations_beyond_a_long():
    q = np.array([[0, 0], [3_037_000_499, 0], [3_037_000_500, 0], [2_200_000_000, 2_200_000_000], [1 << 39, 0], [2_147_483_648, 2_147_483_647]])
    got = whitening._deviations(q, 1, [0, 0], np.zeros(2, np.int64)).to_pylist()
    assert got == [x if (x := int(a) ** 2 + int(b) ** 2) < 1 << 63 else None for a, b in q.tolist()]
