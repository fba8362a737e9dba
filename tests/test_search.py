"""One-to-many search against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from stridelake.operators import search


def by_hand(probes, enrolled, k, last_name):
    out = {}
    for key, e in probes:
        e = np.array(e)
        scored = [(round(float(e @ np.array(s) / (np.linalg.norm(e) * np.linalg.norm(s) + 1e-8)), 9), n) for n, s in enrolled]
        scored.sort(key=lambda x: x[1], reverse=last_name)
        out[key] = sorted(scored, key=lambda x: -x[0])[:k]
    return out


@pytest.mark.parametrize("few,block", [(10_000, 2048), (10_000, 7), (5, 2048), (5, 16)])
@pytest.mark.parametrize("k,last_name", [(1, True), (1, False), (3, False), (4, True)])
def test_best_matches(spark, monkeypatch, few, block, k, last_name):
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    enrolled = [(f"n{i:03d}", (centres[i % 6] + rng.normal(0, 0.1, 8)).tolist()) for i in range(150)]
    enrolled += [("zero", [0.0] * 8), ("twin-a", enrolled[0][1]), ("twin-b", enrolled[0][1])]
    probes = [(str(i), (centres[i % 6] * rng.uniform(0.5, 3) + rng.normal(0, 0.1, 8)).tolist()) for i in range(90)] + [("zero", [0.0] * 8), ("same", enrolled[0][1])]
    p = spark.createDataFrame([*probes, ("null", None)], "key string, e array<double>")
    s = spark.createDataFrame([*enrolled, ("none", None)], "identity string, sig array<double>")
    got = {}
    for r in search.best_matches(p, s, k, 8, last_name, few, pivots=6).collect():
        got.setdefault(r.key, []).append((r.score, r.claimed_identity))
    want = by_hand(probes, enrolled, k, last_name)
    assert {key: sorted(v) for key, v in got.items()} == {key: sorted(v) for key, v in want.items()}


def test_far_blocks_are_skipped():
    pivots = np.eye(8)
    ends = [(10 * c + k, c, 0.1) for c in range(8) for k in range(2)]

    def reached(reach, least):
        batch = pa.RecordBatch.from_pylist([{"block": 1, "cell": 3, "reach": reach, "least": least}])
        return {r["other"] for b in search._reached(pivots, ends)(iter([batch])) for r in b.to_pylist()}

    others = {b for b, c, _ in ends if c != 3}
    assert reached(0.1, 0.9) == set()  # pi / 2 - 0.2 is the least angle
    assert reached(0.1, 0.19) == reached(np.pi, 0.9) == reached(0.1, None) == others


def test_no_pairs_are_planned(spark):
    rng = np.random.default_rng(5)
    rows = lambda n: [(f"{i}", rng.normal(size=8).tolist()) for i in range(n)]
    s, p = spark.createDataFrame(rows(400), "identity string, sig array<double>"), spark.createDataFrame(rows(200), "key string, e array<double>")
    for few in (5, 1000):
        df = search.best_matches(p, s, 1, 8, few=few)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and df.count() == 200
    assert search.best_matches(p, s.limit(0), 1, 8).count() == 0
