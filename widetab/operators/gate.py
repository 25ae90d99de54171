"""A learned noise gate in front of a linear head.

Each feature passes with weight ``w`` and receives noise that grows as the gate closes, so opening the
gate pays only for features that help the prediction. The gate and the head are trained together by
full-batch gradients: an epoch is one pass over the rows in which every task adds up its own gradient,
and the driver updates as many numbers as the table is wide.

The rows are cut into chunks and every chunk into training and validation rows. The same pass gives the gradient of the
training rows and the loss of the validation rows, which see no noise; the gate with the lowest validation loss is kept.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.functions.rng import mix64, stream, unit
from widetab.operators import matrix, split
from widetab.operators.base import ScoreSelector, SelectorModel
from widetab.operators.stats import standard_scales


def projected(w: np.ndarray, k: int, eps: float = 1e-12) -> np.ndarray:
    clipped = np.minimum(np.abs(w), 1.0)
    return clipped / (np.sqrt((clipped**2).sum()) + eps) * np.sqrt(k)


def projection_gradient(w: np.ndarray, k: int, g: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Gradient with respect to the raw weights from the one of the projected weights."""
    clipped = np.minimum(np.abs(w), 1.0)
    norm = np.sqrt((clipped**2).sum()) + eps
    inner = np.sqrt(k) / norm * (g - clipped * (clipped @ g) / norm**2)
    return inner * np.sign(w) * (np.abs(w) < 1.0)


CHUNK_ROWS = 256
VALIDATION = 0.3


def row_noise(seed: int, epoch: int, keys: np.ndarray, d: int) -> np.ndarray:
    """Standard normal noise that belongs to the row, not to the task that reads it: hashes of (row, epoch, feature)."""
    own = mix64(np.asarray(keys).astype(np.int64).view(np.uint64) ^ stream(np.uint64(seed % 2**64), epoch))
    u = unit(stream(own[:, None], np.arange(2 * d)[None, :]))
    return np.sqrt(-2.0 * np.log(1.0 - u[:, :d])) * np.cos(2.0 * math.pi * u[:, d:])


def training_parts(df: DataFrame, seed: int, stratify: bool) -> DataFrame:
    """``(row_id, valid)`` of the rows that are used: chunks of at most 256 rows, 30 % of each for validation.

    A chunk whose parts do not hold equally many classes is left out. Without any chunk that can be used all rows train.
    """
    label = "label" if stratify else None
    parts = split.chunk_holdout(split.chunks(df, CHUNK_ROWS, seed, label), VALIDATION, seed, stratify).persist()
    if stratify:
        covered = split.class_coverage(parts).filter("covered").select("chunk")
        used = parts.join(F.broadcast(covered), "chunk", "left_semi") if covered.limit(split.CHUNKS_SENT + 1).count() <= split.CHUNKS_SENT else parts.join(covered, "chunk", "left_semi")
        parts = used if used.limit(1).count() else parts.withColumn("part", F.lit("train"))
    return parts.select("row_id", (F.col("part") == "test").alias("valid"))


class Adam:
    def __init__(self, lr: float, shapes: dict[str, tuple]):
        self.lr, self.t = lr, 0
        self.m = {n: np.zeros(s) for n, s in shapes.items()}
        self.v = {n: np.zeros(s) for n, s in shapes.items()}

    def step(self, values: dict, gradients: dict) -> None:
        self.t += 1
        for name, g in gradients.items():
            self.m[name] = 0.9 * self.m[name] + 0.1 * g
            self.v[name] = 0.999 * self.v[name] + 0.001 * g * g
            m, v = self.m[name] / (1 - 0.9**self.t), self.v[name] / (1 - 0.999**self.t)
            values[name] = values[name] - self.lr * m / (np.sqrt(v) + 1e-8)


def gradient_pass(rows: DataFrame, d: int, outputs: int, values: dict, k: int, sigma: float, seed: int, epoch: int, regression: bool, mean, scale, y_mean: float, y_scale: float):
    """One epoch: ``(loss, rows, gradients of gate, head and intercept, validation loss)`` summed over the table.

    The validation loss is None when no row is held out.
    """
    shared = rows.sparkSession.sparkContext.broadcast((projected(values["gate"], k), values["head"], values["bias"], mean, scale))

    def errors(gated, y, head, bias):
        """Loss, and its slopes at the outputs."""
        out = gated @ head + bias
        if regression:
            error = out[:, 0] - (y - y_mean) / y_scale
            return 0.5 * (error**2).sum(), error[:, None]
        out -= out.max(1, keepdims=True)
        p = np.exp(out)
        p /= p.sum(1, keepdims=True)
        code = y.astype(int)
        loss = -np.log(np.maximum(p[np.arange(len(y)), code], 1e-15)).sum()
        p[np.arange(len(y)), code] -= 1.0
        return loss, p

    def step(state, keys, labels, column, valid):
        gate, head, bias, centre, spread = shared.value
        whole = (matrix.batch_matrix(column, d) - centre) / spread
        held = valid.to_numpy(zero_copy_only=False).astype(bool)
        target = labels.to_numpy(zero_copy_only=False)
        checked, _ = errors(whole[held] * gate, target[held], head, bias)
        x, y = whole[~held], target[~held]
        noise = row_noise(seed, epoch, keys.to_numpy(zero_copy_only=False)[~held], d) if sigma else np.zeros_like(x)
        gated = x * gate + sigma * (1.0 - np.abs(gate)) * noise
        loss, delta = errors(gated, y, head, bias)
        through = delta @ head.T
        g_gate = (through * (x - sigma * np.sign(gate) * noise)).sum(0)
        # One row per feature: gate gradient, then head gradients; the last two rows hold the totals.
        total = np.zeros((d + 2, 2 + outputs))
        total[:d, 0], total[:d, 1:-1] = g_gate, gated.T @ delta
        total[d, 0], total[d, 1:-1], total[d, -1] = loss, delta.sum(0), len(y)
        total[d + 1, 0], total[d + 1, -1] = checked, held.sum()
        return total if state is None else state + total

    blocks = matrix.add_blocks(
        matrix.partial_blocks(rows, ["_key", "label", "features", "valid"], step, lambda s: matrix._pieces(s, False))
    )
    total = matrix.collect_blocks(blocks, d + 2, outputs + 2)
    shared.unpersist()
    n, held = total[d, -1], total[d + 1, -1]
    slopes = {"gate": total[:d, 0] / n, "head": total[:d, 1:-1] / n, "bias": total[d, 1:-1] / n}
    return total[d, 0] / n, n, slopes, total[d + 1, 0] / held if held else None


class GateSelector(ScoreSelector):
    """Keep the ``num_features`` widest gates, in descending order of weight.

    The gate starts uniform at ``sqrt(k/d)``. Inputs are standardised for the fit only. Labels of a
    classification must be class ids 0..C-1.
    """

    method = "sand_fs"

    def _fit(self, df: DataFrame) -> SelectorModel:
        d = self._width(df)
        k = self._target(d)
        regression = self.get("task_type") == "regression"
        label = F.col("label").cast("double")
        low, high, centre, spread = df.agg(F.min(label), F.max(label), F.avg(label), F.stddev_pop(label)).first()
        outputs = 1 if regression else int(high) + 1
        if not regression and (low < 0 or outputs < 2):
            raise ValueError("the gate needs class ids 0..C-1 of at least two classes")
        scales = standard_scales(df).toPandas().sort_values("feature_idx")
        if len(scales) != d:
            raise ValueError(f"rows have up to {len(scales)} features, not {d}")
        mean, scale = scales["mean"].to_numpy(), scales["scale"].to_numpy()
        rng = np.random.Generator(np.random.Philox(key=self.get("seed")))
        values = {
            "gate": np.full(d, np.sqrt(k / d)),
            "head": rng.standard_normal((d, outputs)) * 0.01,
            "bias": np.zeros(outputs),
        }
        adam = Adam(self.get("lr"), {n: v.shape for n, v in values.items()})
        parts = training_parts(df.select("row_id", "label", "features"), self.get("seed"), not regression)
        keyed = df.select("row_id", F.xxhash64("row_id").alias("_key"), label.alias("label"), "features")
        rows = keyed.join(parts, "row_id").persist()
        self.losses: list[float] = []
        self.val_losses: list[float | None] = []
        best = (np.inf, values["gate"])
        try:
            for epoch in range(self.get("epochs") + 1):  # the last pass only checks the last gate
                loss, _, gradients, checked = gradient_pass(
                    rows, d, outputs, values, k, self.get("sigma"), self.get("seed"), epoch, regression,
                    mean, scale, centre, spread or 1.0,
                )
                if checked is None or epoch and checked < best[0]:
                    best = (np.inf if checked is None else checked, values["gate"])
                if epoch == self.get("epochs"):
                    self.val_losses.append(checked)
                    break
                gradients["gate"] = projection_gradient(values["gate"], k, gradients["gate"])
                adam.step(values, gradients)
                self.losses.append(loss)
                self.val_losses.append(checked)
        finally:
            rows.unpersist()
        weights = projected(best[1], k)
        return self._from_scores(df.sparkSession, [(i, float(w)) for i, w in enumerate(weights)])

    def choose(self, scores):
        from widetab.operators.base import best_first

        return best_first(scores)[: self._target(len(scores))]
