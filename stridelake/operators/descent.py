"""Training of the verification head by synchronous mini-batch descent.

Each step is one Spark job over a part of the pairs: tasks sum gradients, Spark adds them, and the driver, which holds the
head's weights, moves them (Adam with decoupled decay; a gradient longer than `clip` is shortened). Parts are dealt by a hash
of pair and epoch, so every epoch sees each pair once, in other parts each time, and a repeated run takes the same steps. The
learning rate falls on a plateau and training stops early by the rules of history.py. A fit can go on from the state of
an earlier one, which files.save_model keeps like any weights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import VerifierConfig
from . import history
from .gradients import flat, loss_and_gradient, trained
from .head import initial_weights

CURVE = "run string, epoch int, train_loss double, train_accuracy double, val_loss double, val_accuracy double, lr double"
#: Decay of the means of gradients and squares, and what keeps steps finite.
FIRST, SECOND, TINY = 0.9, 0.999, 1e-8


class Fit:
    """Weights, the state of the steps, and a row for each epoch so far."""

    def __init__(self, weights: dict):
        import numpy as np

        size = sum(weights[k].size for k in trained(weights))
        self.weights, self.steps, self.curve = weights, 0, []
        self.first, self.second = np.zeros(size), np.zeros(size)

    def step(self, gradient, rate: float, decay: float, clip: float) -> None:
        import numpy as np

        length = float(np.linalg.norm(gradient))
        g = gradient * min(1.0, clip / length) if length else gradient
        self.steps += 1
        self.first = FIRST * self.first + (1 - FIRST) * g
        self.second = SECOND * self.second + (1 - SECOND) * g * g
        names = trained(self.weights)
        now = flat(self.weights, names)
        move = self.first / (1 - FIRST**self.steps) / (np.sqrt(self.second / (1 - SECOND**self.steps)) + TINY)
        now = now - rate * (move + decay * now)
        at = 0
        for k in names:
            size = self.weights[k].size
            self.weights[k] = now[at : at + size].reshape(self.weights[k].shape)
            at += size

    def state(self) -> dict:
        """Everything as arrays, for files.save_model."""
        import numpy as np

        return self.weights | {"fit/first": self.first, "fit/second": self.second, "fit/steps": np.array([self.steps]), "fit/curve": np.array(self.curve, float).reshape(-1, 6)}

    @classmethod
    def resumed(cls, state: dict) -> Fit:
        own = cls({k: v for k, v in state.items() if not k.startswith("fit/")})
        own.first, own.second, own.steps = state["fit/first"], state["fit/second"], int(state["fit/steps"][0])
        own.curve = [(int(e), *rest) for e, *rest in state["fit/curve"].tolist()]
        return own


def curve(spark, fit: Fit, run: str = "head") -> DataFrame:
    """CURVE: a row an epoch."""
    return spark.createDataFrame([(run, int(e), *map(float, rest)) for e, *rest in fit.curve], CURVE)


def fit_head(
    train: DataFrame, validation: DataFrame, epochs: int, fit: Fit | None = None, config: VerifierConfig = VerifierConfig(), part_rows: int = 256, decay: float = 1e-4, clip: float = 1.0
) -> Fit:
    """Goes on to `epochs` epochs over train, or to where early stopping ends it. Both: pair_id, label, video, claimed.

    Read from written tables, since each step reads its part again.
    """
    fit = fit or Fit(initial_weights(int(config.seed), config.hidden, config.dims))
    shape = {"length": config.length, "dims": config.dims}
    parts = max(1, math.ceil(train.count() / part_rows))
    spark = train.sparkSession
    while len(fit.curve) < epochs:
        rate = config.rate
        if fit.curve:
            past = curve(spark, fit).select("run", "epoch", F.col("val_accuracy").alias("value"))
            if history.early_stop(past, "value", config.patience, config.min_delta).first().stop_epoch is not None:
                break
            rate = history.plateau_rates(past, "value", config.rate, config.rate_patience).orderBy(F.desc("epoch")).first().lr
        epoch, seen, loss, right = len(fit.curve) + 1, 0, 0.0, 0.0
        for part in range(parts):
            own = train.where(F.pmod(F.xxhash64("pair_id", F.lit(epoch)), F.lit(parts)) == part)
            n, part_loss, part_right, gradient = loss_and_gradient(own, fit.weights, **shape)
            if n:
                fit.step(gradient, rate, decay, clip)
                seen, loss, right = seen + n, loss + n * part_loss, right + n * part_right
        _, val_loss, val_right, _ = loss_and_gradient(validation, fit.weights, gradient=False, **shape)
        fit.curve.append((epoch, loss / max(1, seen), right / max(1, seen), val_loss, val_right, rate))
    return fit
