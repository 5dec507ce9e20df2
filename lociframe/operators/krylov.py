"""Mixed models, components and ridge regression for panels of any number of markers, from products alone.

`reml_large`: the profile likelihood needs b'(A + d)^-1 b and log det(A + d) for A = Z'Z / c and any ratio d. Both are
quadratures of Lanczos tridiagonals: one started from b = Z'y, and some from random directions, whose mean is an unbiased estimate
of the trace (with as many probes as markers, unit vectors are used and the trace is exact). All folds and probes advance in
the same passes, until the best ratio of every fold stays. Effects then come from conjugate gradients at that ratio.

`components_large`: block subspace iteration from a random block, with Rayleigh-Ritz values; the residual of a component
bounds how far its variance is from a true one.

`ridge_large`: all strengths of the grid from one run of shifted conjugate gradients for each training set, the best by the
error on the validation family. All components are used: where a panel has no more markers than `ridge.COMPONENTS`, it is
`ridge.fit_nested`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .products import LIMIT, TrainingSets, family_sums, gram_product, grouped, marker_count, squared_errors, training_sets
from .reml import JITTER, LOG_RANGE, best_ratio, blup_filter
from .ridge import COMPONENTS, GRID, feature_filter

Product = Callable[[np.ndarray], np.ndarray]

#: Random probes of the trace; most steps of Lanczos and of conjugate gradients; when a log ratio stays; residual of effects.
PROBES, STEPS, STAYS, RESIDUAL = 24, 120, 1e-5, 1e-9
#: Vectors beyond the wanted components; most passes; when a component's residual is small, as a share of the largest value.
OVERSAMPLE, PASSES, SETTLED = 16, 40, 1e-7

#: One row a fold: effects, means and retained flags of all markers as bytes.
PACKED = (
    "held_out_family string, effects binary, means binary, retained binary, intercept double, lambda_ratio double, genetic_variance double, "
    "residual_variance double, denominator double, n_train long, n_retained int, residual double, trace_error double, steps int"
)
RIDGE = "held_out_family string, effects binary, means binary, retained binary, intercept double, validation_family string, ridge double, validation_mse double, n_retained int, residual double"
COMPONENT = "held_out_family string, component int, explained_variance double, ratio double, error double, loadings binary, weights binary, means binary"


class Lanczos:
    """Tridiagonals of many start vectors (sets x markers x columns, of length one or zero), a step for each product.

    New vectors are made orthogonal to the first `keep` ones again. Beyond these, rounding lets values be found once more,
    which costs steps, not accuracy: the weights of such copies add up to that of the value.
    """

    def __init__(self, start: np.ndarray, keep: int = 0):
        self.q, self.before = start, np.zeros_like(start)
        self.keep, self.basis = keep, []
        self.alpha: list[np.ndarray] = []
        self.beta: list[np.ndarray] = []
        self.going = (start * start).sum(1) > 0

    def step(self, product: Product) -> None:
        w = product(self.q)
        if self.beta:
            w -= self.beta[-1][:, None] * self.before
        a = (self.q * w).sum(1)
        w -= a[:, None] * self.q
        if len(self.basis) < self.keep:
            self.basis.append(self.q)
        for _ in range(2):
            for q in self.basis or [self.q]:
                w -= (q * w).sum(1)[:, None] * q
        b = np.sqrt((w * w).sum(1))
        self.alpha.append(np.where(self.going, a, 0.0))
        # The space is exhausted where nothing new is left.
        self.going &= b > 1e-10 * np.maximum(np.abs(self.alpha[0]), 1e-300)
        b = np.where(self.going, b, 0.0)
        self.beta.append(b)
        self.before, self.q = self.q, np.where(b[:, None] > 0, w / np.where(b > 0, b, 1.0)[:, None], 0.0)

    def nodes(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and weights of the quadrature of one start vector."""
        a, b = np.array([x[i, j] for x in self.alpha]), np.array([x[i, j] for x in self.beta])
        k = int(np.argmax(b == 0)) + 1 if (b == 0).any() else len(a)
        theta, vectors = np.linalg.eigh(np.diag(a[:k]) + np.diag(b[: k - 1], 1) + np.diag(b[: k - 1], -1))
        return np.maximum(theta, 0), vectors[0] ** 2


def _from_basis(runs: Lanczos, norm: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x of (A + shift) x = b in the space that the first start vector of each set has spanned; 0 if vectors are not all kept."""
    q = np.zeros(runs.q.shape[:2])
    if len(runs.basis) < len(runs.alpha):
        return q
    for i in range(len(q)):
        a, b = np.array([x[i, 0] for x in runs.alpha]), np.array([x[i, 0] for x in runs.beta])
        k = int(np.argmax(b == 0)) + 1 if (b == 0).any() else len(a)
        t = np.diag(a[:k] + shift[i]) + np.diag(b[: k - 1], 1) + np.diag(b[: k - 1], -1)
        c = np.linalg.solve(t, np.eye(k)[0] * norm[i])
        for j in range(k):
            q[i] += c[j] * runs.basis[j][i, :, 0]
    return q


def shifted_solutions(product: Product, b: np.ndarray, shifts: np.ndarray, residual: float = RESIDUAL, steps: int = 10 * STEPS, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x of (A + shift) x = b for each set and shift, and the relative residual of the least shift of each set, from one run.

    b: sets x markers; shifts: sets x number, positive; size: squared lengths that residuals are relative to (those of b). A residual of one shift is a multiple of that of the least one,
    never larger, so the run ends when those of all sets are small; raises if steps run out.
    """
    order = np.argsort(shifts, 1)
    s = np.take_along_axis(shifts, order, 1)
    f, m, k = *b.shape, s.shape[1]
    x, p = np.zeros((f, m, k)), np.repeat(b[:, :, None], k, 2)
    r, rr = b.copy(), (b * b).sum(1)
    first = np.maximum(rr if size is None else size, 1e-300)
    zeta, before = np.ones((f, k)), np.ones((f, k))
    alpha, beta = np.ones(f), np.zeros(f)
    for _ in range(steps):
        going = rr > residual**2 * first
        if not going.any():
            break
        q = product(p[:, :, :1])[:, :, 0] + s[:, :1] * p[:, :, 0]
        pq = (p[:, :, 0] * q).sum(1)
        now = np.where(going, rr / np.where(pq > 0, pq, 1.0), 0.0)
        # The recurrences of the other shifts follow those of the least one.
        gap = s - s[:, :1]
        down = alpha[:, None] * before * (1 + now[:, None] * gap) + now[:, None] * beta[:, None] * (before - zeta)
        after = zeta * before * alpha[:, None] / np.where(down == 0, 1.0, down)
        step = now[:, None] * after / np.where(zeta == 0, 1.0, zeta)
        x += np.where(going[:, None], step, 0.0)[:, None] * p
        r = np.where(going[:, None], r - now[:, None] * q, r)
        new = (r * r).sum(1)
        turn = np.where(going, new / np.where(rr > 0, rr, 1.0), 0.0)
        p = np.where(going[:, None, None], after[:, None] * r[:, :, None] + (turn[:, None] * (after / np.where(zeta == 0, 1.0, zeta)) ** 2)[:, None] * p, p)
        before, zeta = np.where(going[:, None], zeta, before), np.where(going[:, None], after, zeta)
        alpha, beta, rr = np.where(going, now, alpha), np.where(going, turn, beta), np.where(going, new, rr)
    else:
        raise RuntimeError(f"conjugate gradients did not converge in {steps} steps: residual {np.sqrt(rr / first).max()}")
    out = np.empty_like(x)
    np.put_along_axis(out, order[:, None, :].repeat(m, 1), x, 2)
    return out, np.sqrt(rr / first)


def _probes(kept: np.ndarray, number: int, seed: int) -> tuple[np.ndarray, bool]:
    """Start vectors of length one over the kept markers of a set (markers x number), and whether they are all unit vectors.

    Random ones are orthogonal to each other, which takes the share number / markers off the variance of their mean.
    """
    at = np.flatnonzero(kept)
    out = np.zeros((len(kept), number))
    if len(at) <= number:
        out[at, np.arange(len(at))] = 1.0
        return out, True
    out[at] = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(at), number)))[0]
    return out, False


def _plan(folds: DataFrame) -> list[str]:
    return sorted(str(r[0]) for r in folds.select(F.col("held_out_family").cast("string")).collect())  # a row for each family


def _packed(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of some folds as a DataFrame; bytes of all markers are in them, so a group's come from the driver as Arrow."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}
    columns = [pa.array([r[i] for r in rows], kinds[x.split()[1]]) for i, x in enumerate(schema.split(", "))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=names))


def _reml_group(product: Product, sets: TrainingSets, denominator: np.ndarray, probes: int, steps: int, seed: int, memory: int) -> list[tuple]:
    scaled = lambda v: product(v) / denominator[:, None, None]
    b = sets.zy
    norm = np.sqrt((b * b).sum(1))
    kept = sets.weight > 0
    started = [_probes(kept[i], probes, seed + i) for i in range(len(b))]
    start = np.concatenate((np.divide(b, norm[:, None], out=np.zeros_like(b), where=norm[:, None] > 0)[:, :, None], np.stack([s for s, _ in started])), 2)
    runs = Lanczos(start, min(steps, memory // start.nbytes))
    centred = sets.syy - sets.sy**2 / sets.n
    for i, n in enumerate(sets.n):
        if n < 3:
            raise ValueError("at least three training samples are needed")
        if not np.isfinite(centred[i]) or centred[i] <= np.finfo(float).eps * max(abs(sets.syy[i]), 1.0):
            raise ValueError("the trait is constant or not finite")

    def fitted(i: int) -> tuple[float, float]:
        """Best log ratio of a set, and the standard error of its log determinant."""
        theta, weight = runs.nodes(i, 0)
        used = [runs.nodes(i, 1 + j) for j in range(probes) if start[i, :, 1 + j].any()]
        size, exact, n, m = kept[i].sum(), started[i][1], sets.n[i], kept[i].sum()
        share = 1.0 if exact else size / len(used)
        traces = lambda d: np.array([(w * np.log(t + d)).sum() for t, w in used]) * share
        best = best_ratio(
            n, lambda d: (centred[i] - norm[i] ** 2 * (weight / (theta + d)).sum() / denominator[i]) / d,
            lambda d: traces(d).sum() + (n - m) * np.log(d),
        )
        error = 0.0 if exact or len(used) < 2 else float(traces(np.exp(best) + JITTER).std(ddof=1) * np.sqrt(len(used) * (1 - len(used) / size)))
        return best, error

    last, stayed = None, 0
    for _ in range(steps):
        runs.step(scaled)
        if len(runs.alpha) < 3 and runs.going.any():
            continue
        now = np.array([fitted(i)[0] for i in range(len(b))])
        stayed = stayed + 1 if last is not None and np.abs(now - last).max() < STAYS else 0
        last = now
        if stayed == 2 or not runs.going.any():
            break
    best = [fitted(i) for i in range(len(b))]
    ratio = np.exp([x for x, _ in best])
    # What Lanczos has found of the effects, and conjugate gradients for what is missing.
    delta = (ratio + JITTER)[:, None]
    known = _from_basis(runs, norm, delta[:, 0])
    rest = b - scaled(known[:, :, None])[:, :, 0] - delta * known
    solved, residual = shifted_solutions(scaled, rest, delta, size=norm**2)
    beta = (known + solved[:, :, 0]) / denominator[:, None]
    genetic = (centred - (b * beta).sum(1)) / (ratio + JITTER) / (sets.n - 1)
    return [
        (name, beta[i].tobytes(), sets.mean[i].tobytes(), kept[i].astype(np.uint8).tobytes(), float(sets.sy[i] / sets.n[i]), float(ratio[i]), float(genetic[i]), float(ratio[i] * genetic[i]),
         float(denominator[i]), int(sets.n[i]), int(kept[i].sum()), float(residual[i]), best[i][1], len(runs.alpha))
        for i, (name, _) in enumerate(sets.names)
    ]


def long_effects(packed: DataFrame, *columns: str) -> DataFrame:
    """held_out_family, marker_pos, retained, mean, beta, intercept and further columns of packed effects, a row for each
    fold and marker."""
    names = ["held_out_family", "intercept", *columns]
    kinds = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                beta, mean, kept = (np.frombuffer(batch.column(len(names) + k)[i].as_py(), d) for k, d in enumerate((float, float, bool)))
                same = [batch.column(k).slice(i, 1).take(pa.array(np.zeros(len(beta), np.int64))) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(beta), dtype=np.int32)), pa.array(kept), pa.array(mean), pa.array(beta)], names=[*names, "marker_pos", "retained", "mean", "beta"])

    return packed.select(*names, "effects", "means", "retained").mapInArrow(run, f"{kinds}, marker_pos int, retained boolean, mean double, beta double")


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reml_large(geno: DataFrame, folds: DataFrame, probes: int = PROBES, steps: int = STEPS, seed: int = 0, limit: int = LIMIT) -> DataFrame:
    """PACKED of every fold (held_out_family of folds); geno: packed rows (family_id, dosages, yield), read once a step.

    trace_error: standard error of the log determinant (0 if exact); residual: of the equations of the effects, relative.
    """
    sums, parts = family_sums(geno).persist(), []
    for group in grouped(_plan(folds), marker_count(geno), 4 * (1 + probes) + 8, limit):
        sets = training_sets(sums, [(f, "final", frozenset([f])) for f in group])
        sets.filtered(lambda s: (blup_filter(s), np.nan_to_num(s["mean"])))
        p = (sets.mean + 1) / 2
        denominator = (2 * p * (1 - p) * (sets.weight > 0)).sum(1)
        parts.append(_packed(geno.sparkSession, _reml_group(gram_product(geno, sets), sets, denominator, probes, steps, seed, 2 * limit), PACKED))
    sums.unpersist()
    return _united(parts)


def _components(product: Product, sets: TrainingSets, limit: int, oversample: int, passes: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Values of Z'Z (largest first), vectors and residuals of each set."""
    f, m = sets.weight.shape
    kept = sets.weight > 0
    width = min(limit + oversample, m)
    draw = np.random.default_rng(seed)
    v = np.zeros((f, m, width))
    for i in range(f):
        own = min(width, int(kept[i].sum()))
        v[i][np.ix_(kept[i], np.arange(own))] = np.linalg.qr(draw.normal(size=(int(kept[i].sum()), own)))[0]
    for _ in range(passes):
        w = product(v)
        out, settled = [], True
        for i in range(f):
            small = v[i].T @ w[i]
            theta, u = np.linalg.eigh((small + small.T) / 2)
            take = np.argsort(theta)[::-1]
            theta, u = np.maximum(theta[take], 0), u[:, take]
            ritz, image = v[i] @ u, w[i] @ u
            k = min(limit, int(sets.n[i]), int(kept[i].sum()))
            residual = np.sqrt(((image - ritz * theta) ** 2).sum(0))[:k]
            settled &= bool((residual <= SETTLED * max(theta[0], 1e-300)).all())
            out.append((theta[:k], ritz[:, :k], residual))
            # Orthonormal within the kept markers; where the image has too little rank, what is missing stays zero.
            q, r = np.linalg.qr(image)
            v[i] = np.where((np.abs(np.diag(r)) > 1e-12 * max(theta[0], 1e-300)) & kept[i][:, None], q, 0.0)
        if settled:
            return out
    return out


def components_large(geno: DataFrame, folds: DataFrame, limit: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 0, memory: int = LIMIT) -> DataFrame:
    """COMPONENT: the leading components of the standardised training markers of every fold, a row each; loadings, weights of
    centred dosages (loadings over deviations) and means as bytes of all markers. The shares use the whole variance, which is
    known without components; error bounds explained_variance."""
    sums, parts = family_sums(geno).persist(), []
    for group in grouped(_plan(folds), marker_count(geno), 5 * (limit + oversample), memory):
        sets = training_sets(sums, [(f, "final", frozenset([f])) for f in group]).filtered(feature_filter, standardise=True)
        rows = []
        for i, (values, vectors, residual) in enumerate(_components(gram_product(geno, sets), sets, limit, oversample, passes, seed)):
            n, kept = sets.n[i], int((sets.weight[i] > 0).sum())
            vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
            rows += [(sets.names[i][0], k, float(values[k] / (n - 1)), float(values[k] / (n * kept)), float(residual[k] / (n - 1)), np.ascontiguousarray(vectors[:, k]).tobytes(), (vectors[:, k] * sets.weight[i]).tobytes(), sets.mean[i].tobytes()) for k in range(len(values))]
        parts.append(_packed(geno.sparkSession, rows, COMPONENT))
    sums.unpersist()
    return _united(parts)


def long_loadings(components: DataFrame) -> DataFrame:
    """COMPONENT as rows of ridge.LOADINGS (loadings that are zero have none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["loadings"])
                at = np.flatnonzero(v)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["held_out_family"]] * n), pa.array([r["component"]] * n, pa.int32()), pa.array(at, pa.int32()), pa.array(v[at]), pa.array([r["explained_variance"]] * n), pa.array([r["ratio"]] * n)],
                    names=["held_out_family", "component", "marker_pos", "loading", "explained_variance", "ratio"],
                )

    return components.mapInArrow(run, "held_out_family string, component int, marker_pos int, loading double, explained_variance double, ratio double")


def _target(sets: TrainingSets) -> tuple[np.ndarray, np.ndarray]:
    mean = sets.sy / sets.n
    std = np.sqrt(np.maximum(sets.syy / sets.n - mean * mean, 0))
    if not np.isfinite(std).all() or (std <= np.finfo(float).eps).any():
        raise ValueError("the trait is constant or not finite")
    return mean, std


def ridge_large(geno: DataFrame, folds: DataFrame, grid: tuple[float, ...] = GRID, limit: int = LIMIT) -> DataFrame:
    """RIDGE of every fold; folds: held_out_family, validation_family. Two runs of conjugate gradients for a group of folds:
    one without the validation family gives all strengths, one with it the chosen one."""
    plan = sorted((str(r[0]), str(r[1])) for r in folds.select(F.col("held_out_family").cast("string"), F.col("validation_family").cast("string")).collect())
    sums, parts = family_sums(geno).persist(), []
    for group in grouped(plan, marker_count(geno), 4 * len(grid) + 12, limit):
        sets = training_sets(sums, [(h, "selection", frozenset([h, v])) for h, v in group]).filtered(feature_filter, standardise=True)
        mean, std = _target(sets)
        strengths = np.array(grid)[None] * sets.n[:, None]
        w, _ = shifted_solutions(gram_product(geno, sets), sets.zy / std[:, None], strengths)
        errors = squared_errors(geno, sets, w, [v for _, v in group], mean, std)
        best = errors.argmin(1)
        sets = training_sets(sums, [(h, "final", frozenset([h])) for h, _ in group]).filtered(feature_filter, standardise=True)
        mean, std = _target(sets)
        chosen = np.array(grid)[best] * sets.n
        w, residual = shifted_solutions(gram_product(geno, sets), sets.zy / std[:, None], chosen[:, None])
        beta = w[:, :, 0] * std[:, None] * sets.weight
        rows = [
            (h, beta[i].tobytes(), sets.mean[i].tobytes(), (sets.weight[i] > 0).astype(np.uint8).tobytes(), float(mean[i]), v, float(grid[best[i]]), float(errors[i, best[i]]), int((sets.weight[i] > 0).sum()), float(residual[i]))
            for i, (h, v) in enumerate(group)
        ]
        parts.append(_packed(geno.sparkSession, rows, RIDGE))
    sums.unpersist()
    return _united(parts)
