"""L1 regression of all folds from one scan.

The training Gram matrix of a fold is that of all rows minus that of the fold, so one pass over the rows (after one for the
means) serves every fold. Coordinate descent then runs on matrices no larger than the table is wide, along a path of
falling penalties: at each step only the features that the strong rule keeps are visited (Tibshirani et al. 2012), and
the optimality conditions of all others are checked before the step counts as done.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.operators import matrix

PATH = 8  # penalties from the largest useful one down to the one asked for
PRECISION = 1e-10  # of a coefficient, as a share of the largest slope


def soft(value: float, penalty: float) -> float:
    return np.sign(value) * max(abs(value) - penalty, 0.0)


def descend(gram: np.ndarray, slopes: np.ndarray, beta: np.ndarray, visited: np.ndarray, penalty: float, sweeps: int, precision: float) -> None:
    """Coordinate descent over ``visited``; ``slopes`` (``c - gram @ beta``) and ``beta`` are changed in place."""
    for _ in range(sweeps):
        largest = 0.0
        for j in visited:
            new = soft(slopes[j] + gram[j, j] * beta[j], penalty) / gram[j, j]
            step = new - beta[j]
            if step:
                slopes -= gram[:, j] * step
                beta[j] = new
                largest = max(largest, abs(step))
        if largest <= precision:
            return


def coefficients(gram: np.ndarray, c: np.ndarray, penalty: float, sweeps: int = 3000) -> np.ndarray:
    """The minimiser of ``beta' gram beta / 2 - c' beta + penalty |beta|_1``. Features without variance get 0."""
    d = len(c)
    beta, slopes = np.zeros(d), c.astype(float).copy()
    usable = np.diag(gram) > 0
    top = float(np.abs(c[usable]).max(initial=0.0))
    if penalty >= top:
        return beta
    before = top
    for step in np.geomspace(top, penalty, PATH)[1:] if penalty > 0 else [0.0]:
        kept = usable & ((np.abs(slopes) >= 2 * step - before) | (beta != 0))
        while True:
            descend(gram, slopes, beta, np.flatnonzero(kept), step, sweeps, PRECISION * top)
            missed = usable & ~kept & (np.abs(slopes) > step * (1 + 1e-9))
            if not missed.any():
                break
            kept |= missed
        before = step
    return beta


def fold_coefficients(df: DataFrame, folds: int, fold: str = "fold", alpha: float | None = None, sweeps: int = 3000) -> list[np.ndarray]:
    """Per fold the coefficients of the standardised features, fitted to the rows of all other folds.

    Without ``alpha`` the penalty of a fold is a tenth of the smallest one that empties its model.
    """
    with_label = df.select(F.col(fold), F.concat("features", F.array(F.col("label").cast("double"))).alias("features"))
    found = []
    for n, _, gram in matrix.fold_covariances(with_label, folds, fold):
        gram = gram / max(n, 1)
        scale = np.sqrt(np.diag(gram)[:-1])
        flat = scale <= 1e-12 * max(scale.max(initial=0.0), 1e-300)
        scale[flat] = 1.0
        z = gram[:-1, :-1] / np.outer(scale, scale)
        c = gram[:-1, -1] / scale
        z[flat], z[:, flat], c[flat] = 0.0, 0.0, 0.0
        found.append(coefficients(z, c, float(0.1 * np.abs(c).max(initial=0.0)) if alpha is None else alpha, sweeps))
    return found


def coefficient_table(df: DataFrame, folds: int, fold: str = "fold", alpha: float | None = None) -> DataFrame:
    """``(fold, feature_idx, coefficient)``."""
    rows = [(f, j, float(v)) for f, beta in enumerate(fold_coefficients(df, folds, fold, alpha)) for j, v in enumerate(beta)]
    return df.sparkSession.createDataFrame(rows, f"{fold} int, feature_idx int, coefficient double")
