"""Variance components and marker effects of leave-one-family-out folds, each fold one group of moments.

With d the eigenvalues of G / c (G = Z'Z of the training columns, c the denominator), the profile REML objective in the
ratio of residual to genetic variance needs d, U'Z'y and three sums only; n x n matrices are never formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .gram import Moments
from .markers import BLUP_MIN_MAF, BLUP_MIN_RATE, BLUP_MIN_VARIANCE

#: Added to the relationship diagonal; range of the log ratio and tolerance of its search.
JITTER = 1e-4
LOG_RANGE, TOLERANCE = (-12.0, 12.0), 1e-8

EFFECTS = (
    "held_out_family string, marker_pos int, retained boolean, mean double, beta double, intercept double, lambda_ratio double, "
    "genetic_variance double, residual_variance double, denominator double, n_train long, n_retained int"
)


def bounded_minimum(f, lo: float, hi: float, tolerance: float = TOLERANCE, grid: int = 49) -> float:
    """Least point of f on [lo, hi]: the best cell of a grid, then golden sections."""
    xs = np.linspace(lo, hi, grid)
    values = [f(x) for x in xs]
    i = int(np.argmin(values))
    a, b = xs[max(i - 1, 0)], xs[min(i + 1, grid - 1)]
    ratio = (np.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2


def best_ratio(n: float, quadratic, log_determinant) -> float:
    """Log ratio of the best profile likelihood; quadratic (residual form over the variance ratio) and log_determinant (of the
    relationship matrix with the ratio on its diagonal) are functions of the ratio plus JITTER."""

    def objective(log_ratio: float) -> float:
        delta = np.exp(log_ratio) + JITTER
        q = quadratic(delta)
        if not q > 0:
            return np.inf
        return 0.5 * (log_determinant(delta) + np.log(n / delta) + (n - 1) * np.log(q / (n - 1)))

    best = bounded_minimum(objective, *LOG_RANGE)
    if not np.isfinite(objective(best)):
        raise ValueError("the likelihood has no finite optimum")
    return best


def fit_reml(g: np.ndarray, zy: np.ndarray, n: float, sy: float, syy: float, denominator: float) -> dict:
    """intercept, lambda_ratio, variances and marker effects from moments (g = Z'Z, zy = Z'y, columns of Z centred)."""
    if n < 3:
        raise ValueError("at least three training samples are needed")
    mean = sy / n
    centred = syy - n * mean * mean
    if not np.isfinite(centred) or centred <= np.finfo(float).eps * max(abs(syy), 1.0):
        raise ValueError("the trait is constant or not finite")
    d, u = np.linalg.eigh(g / denominator)
    if d.min() < -1e-8:
        raise ValueError("the relationship matrix has negative eigenvalues")
    d = np.maximum(d, 0)
    w = u.T @ zy
    m = len(d)

    def quadratic(delta: float) -> float:
        return (centred - (w * w / (denominator * (d + delta))).sum()) / delta

    best = best_ratio(n, quadratic, lambda delta: np.log(d + delta).sum() + (n - m) * np.log(delta))
    ratio = float(np.exp(best))
    delta = ratio + JITTER
    genetic = quadratic(delta) / (n - 1)
    return {"intercept": mean, "lambda_ratio": ratio, "genetic_variance": genetic, "residual_variance": ratio * genetic, "beta": u @ (w / (d + delta)) / denominator}


def blup_filter(s: dict[str, np.ndarray]) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (s["observed_rate"] > BLUP_MIN_RATE) & (s["variance"] > BLUP_MIN_VARIANCE) & (s["maf"] > BLUP_MIN_MAF)


def _fit_fold(rows: pd.DataFrame) -> pd.DataFrame:
    held = rows["held_out_family"].iloc[0]
    moments = Moments(rows)
    stats = moments.statistics()
    keep = blup_filter(stats)
    if not keep.any():
        raise ValueError(f"no marker is left for the fold of {held}")
    p = stats["allele_freq"][keep]
    denominator = float((2 * p * (1 - p)).sum())
    g, zy, _ = moments.centred(np.nan_to_num(stats["mean"]), keep)
    fit = fit_reml(g, zy, moments.n, moments.sy, moments.syy, denominator)
    beta = np.zeros(moments.m)
    beta[keep] = fit.pop("beta")
    return pd.DataFrame(
        {"held_out_family": held, "marker_pos": np.arange(moments.m), "retained": keep, "mean": np.where(keep, stats["mean"], 0.0), "beta": beta}
        | fit | {"denominator": denominator, "n_train": int(moments.n), "n_retained": int(keep.sum())}
    )[[x.split()[0] for x in EFFECTS.split(", ")]]


def fit_lofo(training: DataFrame) -> DataFrame:
    """EFFECTS: a row for each fold and marker; training: gram.training_moments, stage final."""
    return training.filter("stage = 'final'").groupBy("held_out_family").applyInPandas(_fit_fold, EFFECTS)
