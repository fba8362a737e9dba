"""Folds and variants in one pass against one fit for each."""

import numpy as np
import pytest

from stridelake.operators import folds, train
from stridelake.plans import catalog

SF = "/root/testdata/sf0.001"


def ridge(x, y, penalty=folds.RIDGE):
    z = np.hstack([x, np.ones((len(x), 1))])
    p = np.diag([penalty * len(x)] * x.shape[1] + [1e-9 * len(x)])
    return np.linalg.solve(z.T @ z + p, z.T @ (2.0 * y - 1))


def scored(w, x):
    return np.clip((np.hstack([x, np.ones((len(x), 1))]) @ w + 1) / 2, 0, 1)


def one_fit_each(rows):
    """(test_person, key, claimed) -> score, from a fit for each person on the rows that have no part of them."""
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    out = {}
    for person in {r.true_identity for r in rows}:
        others = np.array([person not in (r.true_identity, r.claimed_identity) for r in rows])
        w = ridge(x[others], y[others])
        out |= {(person, r.key, r.claimed_identity): s for r, s in zip(rows, scored(w, x)) if r.true_identity == person}
    return out


@pytest.mark.parametrize("hot", [5, 50_000])
def test_leave_one_out(spark, hot):
    rng = np.random.default_rng(1)
    people = [f"p{i}" for i in range(7)]
    rows = []
    for i in range(120):
        true = people[0] if i % 3 == 0 else people[i % 7]
        claimed = true if i % 2 else people[(i + 1) % 7]
        rows.append((f"k{i}", true, claimed, int(true == claimed), (rng.normal(size=4) + (true == claimed)).tolist()))
    df = spark.createDataFrame(rows, "key string, true_identity string, claimed_identity string, label int, x array<double>")
    got = {(r.test_person, r.key, r.claimed_identity): r.score for r in folds.leave_one_out(df, 4, hot=hot).collect()}
    want = one_fit_each(df.collect())
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_queries_equal_one_fit_each(spark):
    rows = train.pair_features(*catalog._videos(spark, SF)).collect()
    got = {(r.test_person, r.key, r.claimed_identity): r.score for r in catalog.QUERIES["loocv_train"](spark, SF).collect()}
    want = one_fit_each(rows)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-6
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    counts = {}
    for name, dims in train.VARIANTS.items():
        own = x[:, [78 * k + i for k in range(3) for i in dims]]
        p = scored(ridge(own, y), own) > 0.5
        counts[name] = tuple(int(v.sum()) for v in ((y == 1) & p, (y == 0) & p, (y == 0) & ~p, (y == 1) & ~p))
    assert {r.variant: (r.tp, r.fp, r.tn, r.fn) for r in catalog.QUERIES["ablation_grid"](spark, SF).collect()} == counts


def test_the_plan_does_not_grow_with_people(spark):
    plans = []
    for n in (3, 30):
        rows = [(f"k{i}", f"p{i % n}", f"p{(i + 1) % n}", i % 2, [float(i), 1.0]) for i in range(120)]
        df = spark.createDataFrame(rows, "key string, true_identity string, claimed_identity string, label int, x array<double>")
        plans.append(folds.leave_one_out(df, 2)._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert plans[0] == plans[1]
