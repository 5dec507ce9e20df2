"""Matrix-free models against the dense ones and against linear algebra."""

import numpy as np
import pytest
from test_models import panel

from lociframe.operators import encode, folds, gram, krylov, markers, predict, products, reml, ridge
from lociframe.plans import workloads


def packed(dosage):
    return encode.pack(dosage, ("yield",)).persist()


def doubles(df, *columns):
    """Rows by fold, bytes as doubles."""
    return {r["held_out_family"]: r.asDict() | {c: np.frombuffer(r[c]) for c in columns} for r in df.collect()}


@pytest.fixture(scope="module")
def made(spark):
    dosage, samples, x, y, family = panel(spark, per=24, m=20, missing=0.1)
    return dosage, samples, x, y, family, packed(dosage)


@pytest.mark.parametrize("standardise", [False, True])
def test_products_equal_matrices(made, monkeypatch, standardise):
    *_, x, y, family, geno = made
    monkeypatch.setattr(products, "TILE", 7)
    monkeypatch.setattr(products, "DECODED", 100)
    names = [f"P{i}_NAM{i:02d}" for i in range(4)]
    plan = [(names[0], "a", frozenset([names[0]])), (names[1], "b", frozenset([names[1], names[2]])), ("all", "c", frozenset())]
    sets = products.training_sets(products.family_sums(geno.repartition(5)), plan)
    keep = ridge.feature_filter if standardise else lambda s: (reml.blup_filter(s), np.nan_to_num(s["mean"]))
    sets.filtered(keep, standardise)
    v = np.random.default_rng(1).normal(size=(3, 20, 2))
    got = products.gram_product(geno, sets)(v)
    for i, out in enumerate(([0], [1, 2], [])):
        own = ~np.isin(family, out)
        mean = np.nanmean(x[own], 0)
        z = np.where(np.isfinite(x[own]), x[own] - mean, 0.0)
        z = z * (sets.weight[i] > 0) / (z.std(0) if standardise else 1)
        assert np.allclose(got[i], z.T @ (z @ v[i])) and np.allclose(sets.zy[i], z.T @ y[own], atol=1e-6)
        assert sets.n[i] == own.sum() and np.isclose(sets.sy[i], y[own].sum())


def test_families_are_sent_when_they_are_many(made, monkeypatch):
    *_, geno = made
    whole = {(r["name"], r["tile"]): np.frombuffer(r["payload"]) for r in products.family_sums(geno).collect()}
    monkeypatch.setattr(products, "LIMIT", 4)
    again = {(r["name"], r["tile"]): np.frombuffer(r["payload"]) for r in products.family_sums(geno).collect()}
    assert whole.keys() == again.keys() and all(np.allclose(whole[k], again[k]) for k in whole)


def test_shifted_solutions_equal_direct_ones():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(2, 30, 12)) * np.geomspace(1, 30, 12)
    a = z.transpose(0, 2, 1) @ z
    a[1, 5:] = a[1, :, 5:] = 0
    b = rng.normal(size=(2, 12))
    b[1, 5:] = 0
    shifts = np.array([[10.0, 0.5, 1e4, 2.0], [3.0, 1.0, 0.1, 700.0]])
    x, residual = krylov.shifted_solutions(lambda v: a @ v, b, shifts)
    for i in range(2):
        for j in range(4):
            assert np.allclose(x[i, :, j], np.linalg.solve(a[i] + shifts[i, j] * np.eye(12), b[i]), rtol=1e-6, atol=1e-10)
    assert (residual < 1e-8).all() and not np.any(krylov.shifted_solutions(lambda v: a @ v, b * 0, shifts)[0])
    with pytest.raises(RuntimeError):
        krylov.shifted_solutions(lambda v: a @ v, b, shifts, steps=2)


@pytest.mark.parametrize(("keep", "steps"), [(25, 25), (7, 90), (0, 90)])
def test_quadrature_of_lanczos(keep, steps):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 25)) * np.geomspace(0.1, 5, 25)
    a, start = z.T @ z, rng.normal(size=(25, 2))
    start /= np.linalg.norm(start, axis=0)
    runs = krylov.Lanczos(start[None], keep)
    for _ in range(steps):
        runs.step(lambda v: a @ v)
    for j in range(2):
        theta, w = runs.nodes(0, j)
        for d in (0.01, 1.0, 100.0):
            assert np.isclose((w / (theta + d)).sum(), start[:, j] @ np.linalg.solve(a + d * np.eye(25), start[:, j]), rtol=1e-6)


def test_reml_with_exact_traces_is_the_dense_fit(made):
    dosage, samples, *_, geno = made
    dense = reml.fit_lofo(workloads.training(dosage, samples)).toPandas()
    got = doubles(krylov.reml_large(geno, folds.make_folds(samples), probes=20), "effects", "means")
    for name, own in dense.groupby("held_out_family"):
        own, r = own.sort_values("marker_pos"), got[name]
        for c in ("lambda_ratio", "genetic_variance", "residual_variance", "denominator", "intercept"):
            assert np.isclose(r[c], own[c].iloc[0], rtol=1e-4), c
        assert np.allclose(r["effects"], own["beta"], rtol=1e-4, atol=1e-6) and np.allclose(r["means"], own["mean"])
        assert (np.frombuffer(r["retained"], bool) == own["retained"]).all() and r["n_train"] == own["n_train"].iloc[0] and r["trace_error"] == 0 and r["residual"] < 1e-8


def test_reml_with_random_probes(spark):
    dosage, samples, *_ = panel(spark, families=3, per=100, m=90, effect=0.05, seed=5)
    geno = packed(dosage)
    dense = reml.fit_lofo(workloads.training(dosage, samples)).toPandas()
    got = doubles(krylov.reml_large(geno, folds.make_folds(samples), probes=40), "effects")
    for name, own in dense.groupby("held_out_family"):
        own, r = own.sort_values("marker_pos"), got[name]
        assert 0 < r["trace_error"] < 5 and abs(np.log(r["lambda_ratio"] / own["lambda_ratio"].iloc[0])) < 0.35
        assert np.corrcoef(r["effects"], own["beta"])[0, 1] > 0.995


def test_groups_of_folds_give_the_same(made):
    _, samples, *_, geno = made
    plan = folds.make_folds(samples).filter("fold_index < 2")
    one, each = (doubles(krylov.reml_large(geno, plan, probes=20, limit=n), "effects") for n in (1 << 28, 1))
    assert all(np.allclose(one[k]["effects"], each[k]["effects"], rtol=1e-5, atol=1e-7) for k in one) and one.keys() == each.keys()


def test_components_equal_the_dense_ones(made):
    dosage, samples, *_, geno = made
    dense = ridge.pca_loadings(workloads.training(dosage, samples), 6).toPandas().set_index(["held_out_family", "component", "marker_pos"]).sort_index()
    rows = krylov.components_large(geno, folds.make_folds(samples), limit=6, oversample=4)
    got = krylov.long_loadings(rows).toPandas().set_index(["held_out_family", "component", "marker_pos"]).sort_index()
    assert (got.index == dense.index).all()
    for c in ("explained_variance", "ratio", "loading"):
        assert np.allclose(got[c], dense[c], rtol=1e-5, atol=1e-5), c
    assert all(r["error"] < 1e-4 for r in rows.collect())


def test_error_bounds_the_variance(made):
    dosage, samples, *_, geno = made
    every = ridge.pca_loadings(workloads.training(dosage, samples), 20).select("held_out_family", "explained_variance").distinct().toPandas().groupby("held_out_family")["explained_variance"].apply(list)
    for r in krylov.components_large(geno, folds.make_folds(samples), limit=4, oversample=2, passes=2).collect():
        assert min(abs(v - r["explained_variance"]) for v in every[r["held_out_family"]]) <= r["error"] * (1 + 1e-9)


def test_cut_off_of_large_components(made):
    dosage, samples, *_, geno = made
    rows = krylov.components_large(geno, folds.make_folds(samples), limit=20)
    want = ridge.cumulative_variance(ridge.pca_loadings(workloads.training(dosage, samples), 200)).toPandas()
    got = ridge.cumulative_variance(rows).toPandas()
    key = ["held_out_family", "component"]
    both = got.merge(want, on=key, suffixes=("", "_w"))
    assert len(both) == len(want) and np.allclose(both["cumulative"], both["cumulative_w"]) and (both["used"] == both["used_w"]).all()


def test_ridge_of_large_panels_chooses_and_predicts_the_same(made):
    dosage, samples, *_, geno = made
    plan = folds.validation_families(folds.make_folds(samples), 42)
    dense = ridge.fit_nested(workloads.training(dosage, samples, 42), plan).toPandas()
    got = doubles(krylov.ridge_large(geno, plan), "effects")
    for name, own in dense.groupby("held_out_family"):
        own, r = own.sort_values("marker_pos"), got[name]
        assert r["ridge"] == own["ridge"].iloc[0] and r["validation_family"] == own["validation_family"].iloc[0] and np.isclose(r["validation_mse"], own["validation_mse"].iloc[0])
        assert np.allclose(r["effects"], own["beta"], rtol=1e-5, atol=1e-7) and np.isclose(r["intercept"], own["intercept"].iloc[0])


@pytest.mark.parametrize("parts", [1, 5])
def test_packed_scores_equal_joined_ones(made, parts):
    dosage, samples, *_, geno = made
    effects = reml.fit_lofo(workloads.training(dosage, samples))
    want = {tuple(r)[:2]: r["predicted"] for r in predict.predict_long(dosage, effects).collect()}
    got = {tuple(r)[:2]: r["predicted"] for r in predict.predict_packed(geno.repartition(3), predict.pack_effects(effects), parts).collect()}
    assert want.keys() == got.keys() and all(np.isclose(want[k], got[k]) for k in want)
    some = predict.pack_effects(effects).filter("held_out_family <> 'P1_NAM01'")
    assert predict.predict_packed(geno, some).count() == 72
    assert predict.predict_packed(geno.limit(0), some).count() == 0


def test_packed_projection_equals_the_joined_one(made, spark):
    dosage, samples, *_, geno = made
    rows = krylov.components_large(geno, folds.make_folds(samples), limit=4, oversample=4)
    z = markers.impute_center(dosage, markers.filter_feature(markers.lofo_marker_stats(dosage, samples)), scale=True)
    want = {tuple(r)[:3]: r["score"] for r in predict.project(z, krylov.long_loadings(rows)).collect()}
    got = {tuple(r)[:3]: r["score"] for r in predict.project_packed(geno, rows).collect()}
    assert want.keys() == got.keys() and all(np.isclose(want[k], got[k]) for k in want)


def test_no_join_of_cells_in_packed_scoring(made):
    dosage, samples, *_, geno = made
    plan = predict.predict_packed(geno, predict.pack_effects(reml.fit_lofo(workloads.training(dosage, samples))))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[1].split("InMemoryRelation")[0]


@pytest.mark.parametrize("part", ["train", "test", "own"])
def test_relationships_of_all_folds(made, part):
    dosage, samples, x, y, family, geno = made
    stats = markers.filter_blup(markers.lofo_marker_stats(dosage, samples))
    got = gram.fold_relationships(geno, stats, part, jitter=0.5, block=10).toPandas()
    for f in range(4):
        own = family != f
        mean = np.nanmean(x[own], 0)
        filled = np.where(np.isfinite(x), x, mean)
        p = (mean + 1) / 2
        keep = (np.isfinite(x[own]).mean(0) > 0.1) & (filled[own].var(0) > 1e-6) & (np.minimum(p, 1 - p) > 0.05)
        z = (filled - mean)[:, keep]
        k = z @ z.T / (2 * p * (1 - p))[keep].sum() + (0.5 * np.eye(len(z)) if part != "test" else 0)
        left, right = {"train": (own, own), "test": (~own, own), "own": (~own, ~own)}[part]
        rows = got[got["fold"] == f"P{f}_NAM{f:02d}"]
        full = np.full(k.shape, np.nan)
        full[rows["sample_i"], rows["sample_j"]] = rows["value"]
        assert len(rows) == left.sum() * right.sum() and np.allclose(full[np.ix_(left, right)], k[np.ix_(left, right)])


def test_fifty_thousand_markers(spark):
    """A panel whose Gram matrix would take 20 GB, in groups of vectors of 8 MB."""
    rng = np.random.default_rng(8)
    n, m, per = 60, 50_000, 20
    x = rng.integers(-1, 2, (n, m)).astype(np.int8)
    y = 3000 + x[:, :40] @ rng.normal(size=40) * 8 + rng.normal(size=n) * 5
    raw = np.where(rng.random(x.shape) < 0.02, encode.MISSING, x).astype(np.int8)
    rows = [(f"F{i // per}", f"s{i:03d}", i, float(y[i]), raw[i].tobytes()) for i in range(n)]
    geno = spark.createDataFrame(rows, "family_id string, sample_id string, sample_pos long, yield double, dosages binary").repartition(3).persist()
    samples = geno.drop("dosages")
    oof, effects = workloads.gblup_lofo_large(geno, samples, probes=2, limit=8 << 20)
    seen = raw != encode.MISSING
    for r in effects.collect():
        own = np.arange(n) // per != int(r["held_out_family"][1:])
        mean = np.where(seen[own], x[own], 0).sum(0) / seen[own].sum(0)
        z = np.where(seen, x - mean, 0.0)
        z[:, ~np.frombuffer(r["retained"], bool)] = 0
        k = z[own] @ z[own].T / r["denominator"]
        # The dual form at the ratio found, and the residual of the equations.
        alpha = np.linalg.solve(k + (r["lambda_ratio"] + reml.JITTER) * np.eye(own.sum()), y[own] - r["intercept"])
        assert np.allclose(np.frombuffer(r["effects"]), z[own].T @ alpha / r["denominator"], atol=1e-7) and r["residual"] < 1e-8 and r["n_retained"] > 45_000
        got = {x["sample_name"]: x["predicted_yield_kg_ha"] for x in oof.filter(f"family_id = '{r['held_out_family']}'").collect()}
        assert np.allclose([got[f"s{i:03d}"] for i in np.flatnonzero(~own)], r["intercept"] + z[~own] @ z[own].T @ alpha / r["denominator"], rtol=1e-6)


@pytest.mark.parametrize("part", ["train", "test", "own"])
def test_sums_of_relationships_without_their_cells(made, part):
    dosage, samples, x, y, family, geno = made
    stats = markers.filter_blup(markers.lofo_marker_stats(dosage, samples))
    cells = gram.fold_relationships(geno, stats, part, jitter=0.5, block=10).toPandas()
    cells["w"] = cells["value"] * (cells["sample_j"] % 5)
    names = {r["sample_pos"]: r["sample_id"] for r in geno.select("sample_pos", "sample_id").collect()}
    want = {(f, names[i]): (len(g), g["w"].sum(), g["value"][g["sample_i"] == g["sample_j"]].sum()) for (f, i), g in cells.groupby(["fold", "sample_i"])}
    weighted = geno.withColumn("weight", geno["sample_pos"] % 5)
    got = {(r["fold"], r["sample_i"]): (r["n"], r["row_sum"], r["diagonal"] or 0.0) for r in gram.relationship_sums(weighted, stats, part, jitter=0.5, parts=3).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert gram.relationship_sums(weighted.limit(0), stats, part).count() == 0


def test_sums_of_many_samples(spark):
    """Nine matrices of 40 000 x 36 000 cells or so, of which none is made."""
    rng = np.random.default_rng(3)
    n, m = 40_000, 8
    x = rng.integers(-1, 2, (n, m)).astype(np.int8)
    geno = spark.createDataFrame([(f"F{i % 10}", f"s{i}", i, i % 7, x[i].tobytes()) for i in range(n)], "family_id string, sample_id string, sample_pos long, weight long, dosages binary").repartition(4)
    stats = spark.createDataFrame([(f"F{f}", j, 0.25 * j / m, (0.25 * j / m + 1) / 2, j != 3) for f in range(10) for j in range(m)], "held_out_family string, marker_pos int, mean double, allele_freq double, retained boolean")
    got = gram.relationship_sums(geno, stats, "train").filter("sample_i = 's12345'").collect()
    mean, keep = 0.25 * np.arange(m) / m, np.arange(m) != 3
    z, p = (x - mean)[:, keep], (mean[keep] + 1) / 2
    for r in got:
        own = np.arange(n) % 10 != int(r["fold"][1:])
        assert r["n"] == own.sum() and np.isclose(r["row_sum"], z[12345] @ (z[own].T @ (np.arange(n)[own] % 7)) / (2 * p * (1 - p)).sum())
    assert len(got) == 9
