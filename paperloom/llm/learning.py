"""What the trained operators share: the held-out fold, bounded samples, small linear models in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, folds: int = 5) -> Column:
    """True for the fold that is never learned from: crc32 of the id's text divisible by ``folds``; null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def bounded_sample(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """All rows if they are at most ``bound``, else those with the smallest hashes of the id: about 0.95 x bound rows.

    The choice depends on ids alone and needs no sort.
    """
    n = rows.count()
    if n <= bound:
        return rows
    space = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(space)) < int(space * 0.95 * bound / n))


def fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, classes weighted evenly) by accelerated gradient; y is -1 or 1."""
    n = len(y)
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    xb = np.hstack([x, np.ones((n, 1))]).astype(np.float32)
    bound = 2 * float((weight * (xb**2).sum(axis=1)).sum()) + reg
    w = np.zeros(xb.shape[1], np.float32)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (xb @ v))
        grad = -2 * ((weight * slack * y) @ xb) + reg * v
        new = (v - grad / bound).astype(np.float32)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + np.float32((t - 1) / nt) * (new - w), new, nt
    return w[:-1], float(w[-1])


def fit_slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope a of the logistic function that turns margins into probabilities, by Newton's method; y is -1 or 1."""
    a = 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(a * y * margin, -50, 50)))
        h = float((p * (1 - p) * margin**2).sum()) + 1e-3
        a += float((p * y * margin).sum() - 1e-3 * a) / h
        a = min(max(a, 0.1), 50.0)
    return a


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, reg: float = 1e-2, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets in 0 to 1 by accelerated gradient; the intercept isn't regularised."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    bound = 0.25 * float((weight * (xb**2).sum(axis=1)).sum()) + reg
    penalty = np.full(xb.shape[1], reg)
    penalty[-1] = 0
    w = np.zeros(xb.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ v, -50, 50)))
        grad = (weight * (p - target)) @ xb + penalty * v
        new = v - grad / bound
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w[:-1], float(w[-1])
