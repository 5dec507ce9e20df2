"""Principal components of training markers and ridge regression on them, chosen on a validation family, then refitted.

All of it is computed from moments (gram.py), one fold a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .gram import Moments
from .markers import FEATURE_MIN_MAF, FEATURE_MIN_RATE, FEATURE_MIN_VARIANCE

COMPONENTS = 64
#: Ridge strengths, as multiples of the number of training rows.
GRID = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)

MODEL = (
    "held_out_family string, marker_pos int, retained boolean, mean double, beta double, intercept double, validation_family string, "
    "ridge double, validation_mse double, n_components int"
)
LOADINGS = "held_out_family string, component int, marker_pos int, loading double, explained_variance double, ratio double"


def feature_filter(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    mean = np.nan_to_num(s["mean"])
    p = np.clip((mean + 1) / 2, 0, 1)
    keep = (s["observed_rate"] >= FEATURE_MIN_RATE) & (np.minimum(p, 1 - p) >= FEATURE_MIN_MAF) & (s["variance"] > FEATURE_MIN_VARIANCE)
    return keep, mean


def components(moments: Moments, limit: int = COMPONENTS) -> dict:
    """Kept markers, their means and scales, loadings (largest absolute loading positive), variances and ratios."""
    if moments.n < 2:
        raise ValueError("at least two rows are needed")
    stats = moments.statistics()
    keep, mean = feature_filter(stats)
    if not keep.any():
        raise ValueError("no marker is left")
    g, zy, z1 = moments.centred(mean, keep)
    scale = np.sqrt(stats["variance"][keep])
    g = g / np.outer(scale, scale)
    d, v = np.linalg.eigh(g)
    k = min(limit, int(moments.n), int(keep.sum()))
    order = np.argsort(d)[::-1][:k]
    v = v[:, order]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(k)])
    variance = np.maximum(d[order], 0) / (moments.n - 1)
    return {"keep": keep, "mean": mean, "scale": scale, "g": g, "zy": zy / scale, "v": v, "d": np.maximum(d[order], 0), "variance": variance, "ratio": variance / max(np.maximum(d, 0).sum() / (moments.n - 1), 1e-300)}


def target_scale(m: Moments) -> tuple[float, float]:
    mean = m.sy / m.n
    std = float(np.sqrt(max(m.syy / m.n - mean * mean, 0)))
    if not np.isfinite(std) or std <= np.finfo(float).eps:
        raise ValueError("the trait is constant or not finite")
    return float(mean), std


def _weights(c: dict, ridge: float, std: float) -> np.ndarray:
    """Weights of kept, standardised markers for the standardised target."""
    return c["v"] @ ((c["v"].T @ c["zy"]) / std / (c["d"] + ridge))


def validation_mse(own: Moments, c: dict, w: np.ndarray, mean: float, std: float) -> float:
    """Mean squared error of standardised predictions on other rows, from their moments."""
    g, zy, z1 = own.centred(c["mean"], c["keep"])
    w = w / c["scale"]
    yy = (own.syy - 2 * mean * own.sy + own.n * mean * mean) / std**2
    fy = (w @ zy - mean * (w @ z1)) / std
    return float((yy - 2 * fy + w @ g @ w) / own.n)


def _fit_fold(rows: pd.DataFrame, plan: dict[str, str], grid: tuple[float, ...], limit: int) -> pd.DataFrame:
    held = rows["held_out_family"].iloc[0]
    final, selection, own = (Moments(rows[rows["stage"] == s]) for s in ("final", "selection", "validation"))
    c = components(selection, limit)
    mean, std = target_scale(selection)
    errors = [validation_mse(own, c, _weights(c, r * selection.n, std), mean, std) for r in grid]
    best = int(np.argmin(errors))
    c = components(final, limit)
    mean, std = target_scale(final)
    beta = np.zeros(final.m)
    beta[c["keep"]] = _weights(c, grid[best] * final.n, std) * std / c["scale"]
    return pd.DataFrame({
        "held_out_family": held, "marker_pos": np.arange(final.m), "retained": c["keep"], "mean": np.where(c["keep"], c["mean"], 0.0), "beta": beta, "intercept": mean,
        "validation_family": plan[held], "ridge": grid[best], "validation_mse": errors[best], "n_components": c["v"].shape[1],
    })


def fit_nested(training: DataFrame, folds: DataFrame, grid: tuple[float, ...] = GRID, limit: int = COMPONENTS) -> DataFrame:
    """MODEL: a row for each fold and marker, usable by predict.predict_long."""
    plan = {r["held_out_family"]: r["validation_family"] for r in folds.select("held_out_family", "validation_family").collect()}
    return training.groupBy("held_out_family").applyInPandas(lambda rows: _fit_fold(rows, plan, grid, limit), MODEL)


#: Share of variance that components must reach, and the most components, of the plain rule.
TARGET, MOST = 0.90, 200


def cumulative_variance(loadings: DataFrame, target: float = TARGET, most: int = MOST) -> DataFrame:
    """held_out_family, component, ratio, cumulative, used: components up to the first whose cumulative share of variance
    reaches the target, most at most; all of them if none does."""
    rows = loadings.select("held_out_family", "component", "ratio").distinct()
    by = Window.partitionBy("held_out_family").orderBy("component")
    rows = rows.withColumn("cumulative", F.sum("ratio").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.coalesce(F.lag("cumulative").over(by), F.lit(0.0))
    return rows.withColumn("used", (before < target) & (F.col("component") < most))


def pca_to_variance(training: DataFrame, target: float = TARGET, most: int = MOST) -> DataFrame:
    """LOADINGS of the components that `cumulative_variance` uses."""
    every = pca_loadings(training, most)
    used = cumulative_variance(every, target, most).filter("used").select("held_out_family", "component")
    return every.join(F.broadcast(used), ["held_out_family", "component"])  # `most` rows a fold


def fold_results(model: DataFrame, fold_metrics: DataFrame, folds: DataFrame) -> DataFrame:
    """fold_index, held_out_family, validation_family, fold_seed, ridge, validation_mse, n_components, r, rmse of each fold."""
    best = model.groupBy("held_out_family").agg(*[F.first(c).alias(c) for c in ("validation_family", "ridge", "validation_mse", "n_components")])
    plan = folds.select("fold_index", F.col("held_out_family").cast("string").alias("held_out_family"), "fold_seed")
    score = fold_metrics.select(F.col("family_id").cast("string").alias("held_out_family"), "r", "rmse")
    out = plan.join(best, "held_out_family").join(score, "held_out_family", "left")
    return out.select("fold_index", "held_out_family", "validation_family", "fold_seed", "ridge", "validation_mse", "n_components", "r", "rmse")


def pca_loadings(training: DataFrame, limit: int = COMPONENTS) -> DataFrame:
    """LOADINGS of the final training set of every fold."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = components(Moments(rows), limit)
        k, at = c["v"].shape[1], np.flatnonzero(c["keep"])
        return pd.DataFrame({
            "held_out_family": rows["held_out_family"].iloc[0], "component": np.repeat(np.arange(k), len(at)), "marker_pos": np.tile(at, k), "loading": c["v"].T.ravel(),
            "explained_variance": np.repeat(c["variance"], len(at)), "ratio": np.repeat(c["ratio"], len(at)),
        })

    return training.filter("stage = 'final'").groupBy("held_out_family").applyInPandas(run, LOADINGS)
