"""Gradients against central differences, attributions and training against plain loops."""

import numpy as np
import pytest

from stridelake.operators import descent, gradients, head
from stridelake.schema import VerifierConfig
from stridelake.sources import files

SMALL = VerifierConfig(length=6, dims=3, hidden=4, seed="1", rate=0.01, patience=3, rate_patience=0)


@pytest.fixture(scope="module")
def weights():
    w, rng = head.initial_weights(3, hidden=4, dims=3), np.random.default_rng(9)
    return {k: v + (rng.uniform(0.1, 0.5, v.shape) if k.startswith("var") else rng.normal(0, 0.2, v.shape)) for k, v in w.items()}


def pairs(spark, n, seed=0):
    """Authentic pairs are near to what they claim."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        label, claimed = i % 2, rng.normal(size=(6, 3))
        video = claimed + rng.normal(0, 0.2, (6, 3)) if label else rng.normal(size=(6, 3))
        rows.append((f"{seed}-{i}", label, video.ravel().tolist(), claimed.ravel().tolist()))
    return spark.createDataFrame(rows, "pair_id string, label int, video array<double>, claimed array<double>"), rows


def shaped(rows):
    return (np.array([r[c] for r in rows]).reshape(-1, 6, 3) for c in (2, 3))


def test_forward_is_that_of_the_head(weights):
    a, b = np.random.default_rng(1).normal(size=(2, 5, 6, 3))
    assert np.allclose(gradients.forward(weights, a, b)[0], head.forward(weights, a, b))


def test_gradients_are_central_differences(weights):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 3, 6, 3))
    slope = rng.normal(size=(3, 2))
    value = lambda w, x: float((gradients.forward(w, x, b)[0] * slope).sum())
    grads, of_video = gradients.backward(weights, gradients.forward(weights, a, b)[1], slope)
    h = 1e-6
    for at in np.ndindex(a.shape):
        step = np.zeros(a.shape)
        step[at] = h
        assert abs((value(weights, a + step) - value(weights, a - step)) / (2 * h) - of_video[at]) < 1e-5
    assert set(grads) == set(gradients.trained(weights))
    for k, g in grads.items():
        assert g.shape == weights[k].shape
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 25)]:
            step = np.zeros(g.shape)
            step[at] = h
            both = [value(weights | {k: weights[k] + s * step}, a) for s in (1, -1)]
            assert abs((both[0] - both[1]) / (2 * h) - g[at]) < 1e-5


@pytest.mark.parametrize("target", [None, 0, 1])
def test_attributions(spark, weights, target):
    df, rows = pairs(spark, 40)
    a, b = shaped(rows)
    logits = head.forward(weights, a, b)
    want = {}
    for i, (pair_id, *_) in enumerate(rows):
        which = int(logits[i].argmax()) if target is None else target
        for at in np.ndindex(6, 3):
            step = np.zeros((1, 6, 3))
            step[(0, *at)] = 1e-6
            ends = [head.forward(weights, a[i : i + 1] + s * step, b[i : i + 1])[0, which] for s in (1, -1)]
            want[pair_id, *at] = abs(a[i][at]) * abs(ends[0] - ends[1]) / 2e-6
    got = {(r.sample_id, r.frame_idx, r.dim): r.value for r in gradients.attribute(df.repartition(3), weights, target, 6, 3).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_gradient_is_the_sum_over_tasks(spark, weights):
    df, rows = pairs(spark, 50)
    a, b = shaped(rows)
    label = np.array([r[1] for r in rows])
    logits, way = gradients.forward(weights, a, b)
    p = gradients.softmax(logits)
    slope = p - np.eye(2)[label]
    want = gradients.flat(gradients.backward(weights, way, slope)[0], gradients.trained(weights)) / 50
    for parts in (1, 7):
        n, loss, right, got = gradients.loss_and_gradient(df.repartition(parts), weights, 6, 3)
        assert n == 50 and np.allclose(got, want) and np.isclose(loss, -np.log(p[np.arange(50), label]).mean()) and np.isclose(right, (logits.argmax(1) == label).mean())
    assert gradients.loss_and_gradient(df.limit(0), weights, 6, 3) == (0, 0.0, 0.0, None)


def test_training_learns_and_goes_on_where_it_ended(spark, tmp_path):
    (train, _), (val, rows) = pairs(spark, 160), pairs(spark, 80, seed=5)
    train, val = train.cache(), val.cache()
    whole = descent.fit_head(train, val, 12, config=SMALL, part_rows=40)
    assert whole.curve[-1][1] < whole.curve[0][1] and max(c[4] for c in whole.curve) > 0.9
    half = descent.fit_head(train, val, 2, config=SMALL, part_rows=40)
    files.save_model(spark, half.state(), spark.range(0), f"{tmp_path}/half")
    state, _ = files.load_model(spark, f"{tmp_path}/half")
    rest = descent.fit_head(train, val, 12, descent.Fit.resumed(state), SMALL, part_rows=40)
    assert np.allclose(np.array(rest.curve), np.array(whole.curve)) and rest.steps == whole.steps
    assert [r.epoch for r in descent.curve(spark, whole).collect()] == [c[0] for c in whole.curve]
    # the rate was cut where accuracy did not grow, and the weights that are left score like the curve says
    a, b = shaped(rows)
    right = (head.forward(whole.weights, a, b).argmax(1) == [r[1] for r in rows]).mean()
    assert np.isclose(right, whole.curve[-1][4])
    train.unpersist(), val.unpersist()


def test_early_stopping(spark):
    train, val = pairs(spark, 20)[0].cache(), pairs(spark, 10, seed=6)[0].cache()
    still = VerifierConfig(length=6, dims=3, hidden=4, seed="1", rate=0.0, patience=2)
    assert len(descent.fit_head(train, val, 9, config=still).curve) == 3
    train.unpersist(), val.unpersist()


def test_long_gradients_are_shortened():
    fit = descent.Fit(head.initial_weights(1, hidden=4, dims=3))
    g = np.full(fit.first.size, 10.0)
    fit.step(g, 0.1, 0.0, 1.0)
    assert np.isclose(np.linalg.norm(fit.first) / (1 - descent.FIRST), 1.0)


def test_queries_of_the_head(spark):
    """Whole outputs against one pair after another."""
    from stridelake.plans import catalog

    sf, w = "/root/testdata/sf0.001", head.initial_weights()
    rows = {r.pair_id: r for r in catalog._head_pairs(spark, sf).collect()}
    assert {r.label for r in rows.values()} == {0, 1} and len(rows) == 2 * len({k.split("|")[0] for k in rows})
    scores = {r.pair_id: r for r in catalog.QUERIES["head_forward"](spark, sf).collect()}
    got = {}
    for r in catalog.QUERIES["input_attribution"](spark, sf).collect():
        got.setdefault(r.sample_id, np.empty((60, 78)))[r.frame_idx, r.dim] = r.value
    assert scores.keys() == rows.keys() == got.keys()
    joints, groups = np.zeros(12), np.zeros(3)
    frames = {(r.sample_id, r.frame_idx): r.weight for r in catalog.QUERIES["gradient_temporal"](spark, sf).collect()}
    assert len(frames) == 60 * len(rows)
    for k, r in rows.items():
        a, b = (np.array(x).reshape(1, 60, 78) for x in (r.video, r.claimed))
        logits, way = gradients.forward(w, a, b)
        p = gradients.softmax(logits)[0]
        assert abs(scores[k].p_authentic - p[1]) < 1e-4 and abs(scores[k].confidence - p.max()) < 1e-4
        value = np.abs(a * gradients.backward(w, way, np.eye(2)[logits.argmax(1)])[1])[0]
        assert np.abs(value - got[k]).max() < 2e-6
        by_frame = value.sum(axis=1)
        assert np.allclose([frames[k, t] for t in range(60)], by_frame / by_frame.max(), atol=1e-5)
        at = np.unravel_index(value.argmax(), value.shape)
        step = np.zeros(a.shape)
        step[(0, *at)] = 1e-6
        slope = (head.forward(w, a + step, b) - head.forward(w, a - step, b))[0, logits.argmax()] / 2e-6
        assert abs(abs(a[(0, *at)] * slope) - value[at]) < 1e-4
        joints += (value[:, :36].reshape(-1, 12, 3).sum((0, 2)) + value[:, 42:].reshape(-1, 12, 3).sum((0, 2))) / len(rows)
        groups += (value[:, :36].sum(), value[:, 36:42].sum(), value[:, 42:].sum())
    ranked = {r.joint: r.importance for r in catalog.QUERIES["gradient_rank_joints"](spark, sf).collect()}
    assert np.allclose([ranked[j] for j in range(12)], joints / joints.max(), atol=1e-5)
    shares = {r.feature_group: r.share for r in catalog.QUERIES["gradient_rollup"](spark, sf).collect()}
    assert np.allclose([shares[g] for g in ("coords", "angles", "velocities")], groups / groups.sum(), atol=1e-5)
    curve = catalog.QUERIES["head_training"](spark, sf).orderBy("epoch").collect()
    assert [r.epoch for r in curve] == list(range(1, 7)) and curve[-1].train_loss < curve[0].train_loss
