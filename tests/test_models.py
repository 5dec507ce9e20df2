import numpy as np
import pytest
from pyspark.sql.functions import col

from lociframe.operators import encode, folds, gram, graph, markers, metrics, qc, reml, ridge
from lociframe.plans import workloads


def panel(spark, families=4, per=30, m=24, seed=7, missing=0.05, effect=1.0):
    rng = np.random.default_rng(seed)
    x = rng.integers(-1, 2, (families * per, m)).astype(float)
    beta = rng.normal(size=m) * effect
    y = 3000 + x @ beta * 20 + rng.normal(size=len(x)) * 5
    seen = rng.random(x.shape) > missing
    rows = [(f"P{i // per}_NAM{i // per:02d}", f"s{i:04d}", i, f"m{j:03d}", j, int(x[i, j]) if seen[i, j] else None, float(y[i])) for i in range(len(x)) for j in range(m)]
    dosage = spark.createDataFrame(rows, "family_id string, sample_id string, sample_pos long, marker_id string, marker_pos int, dosage int, yield double")
    samples = dosage.select("family_id", "sample_id", "sample_pos", "yield").distinct()
    return dosage, samples, np.where(seen, x, np.nan), y, np.repeat(np.arange(families), per)


def restricted_likelihood(k, y, ratio):
    """Profile restricted log likelihood of y ~ N(mu, s (k + ratio I)) up to a constant, its mu, s and V^-1 (y - mu)."""
    n = len(y)
    v = k + ratio * np.eye(n)
    w = np.linalg.solve(v, np.ones(n))
    mu = w @ y / w.sum()
    a = np.linalg.solve(v, y - mu)
    s = (y - mu) @ a / (n - 1)
    return -0.5 * (np.linalg.slogdet(v)[1] + np.log(w.sum()) + (n - 1) * np.log(s)), mu, s, a


def dense_fit(k, y):
    """The best of a grid of ratios, refined twice."""
    lo, hi = np.exp(-12), np.exp(12)
    for _ in range(7):
        grid = np.geomspace(lo, hi, 41)
        i = int(np.argmax([restricted_likelihood(k, y, r)[0] for r in grid]))
        lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, 40)]
    ratio = float(np.sqrt(lo * hi))
    _, mu, s, a = restricted_likelihood(k, y, ratio)
    return {"intercept": mu, "lambda_ratio": ratio, "genetic_variance": s, "alpha": a}


def dense_fold(x, y, family, held):
    """Relationship, REML and predictions of one fold by n x n matrices."""
    train, test = family != held, family == held
    n = train.sum()
    rate, mean = np.isfinite(x[train]).mean(0), np.nanmean(x[train], 0)
    filled = np.where(np.isfinite(x), x, mean)
    p = (mean + 1) / 2
    keep = (rate > 0.1) & (filled[train].var(0) > 1e-6) & (np.minimum(p, 1 - p) > 0.05)
    z = (filled - mean)[:, keep]
    c = 2 * (p * (1 - p))[keep].sum()
    k = z[train] @ z[train].T / c + 1e-4 * np.eye(n)
    fit = dense_fit(k, y[train])
    return fit, fit["intercept"] + z[test] @ z[train].T / c @ fit["alpha"]


def test_primal_equals_dual(spark):
    dosage, samples, x, y, family = panel(spark)
    oof, effects = workloads.gblup_lofo(dosage, samples)
    got = oof.toPandas().set_index("sample_name")["predicted_yield_kg_ha"]
    fits = effects.toPandas().groupby("held_out_family").first()
    for f in range(4):
        fit, predicted = dense_fold(x, y, family, f)
        names = [f"s{i:04d}" for i in np.flatnonzero(family == f)]
        assert np.allclose(got[names], predicted, atol=1e-4)
        assert np.isclose(fits.loc[f"P{f}_NAM{f:02d}", "lambda_ratio"], fit["lambda_ratio"], rtol=1e-3)
    assert metrics.missing_predictions(oof).count() == 0


def test_signal_is_recovered_and_held_out_traits_do_not_matter(spark):
    dosage, samples, _, y, family = panel(spark, seed=20260810, per=45)
    oof, _ = workloads.gblup_lofo(dosage, samples)
    p = oof.toPandas()
    assert np.corrcoef(p["observed_yield_kg_ha"], p["predicted_yield_kg_ha"])[0, 1] > 0.9
    from pyspark.sql import functions as F

    other = F.when(F.col("family_id") == "P0_NAM00", F.col("yield") * -3).otherwise(F.col("yield"))
    again, _ = workloads.gblup_lofo(dosage.withColumn("yield", other), samples.withColumn("yield", other))
    q = again.toPandas().set_index("sample_name")["predicted_yield_kg_ha"]
    p = p[p["family_id"] == "P0_NAM00"].set_index("sample_name")["predicted_yield_kg_ha"]
    assert np.allclose(p, q[p.index])


def test_partitioning_does_not_matter(spark):
    dosage, samples, *_ = panel(spark, per=10)
    geno = encode.pack(dosage, ("yield",))
    a, b = gram.family_gram(geno, salts=1), gram.family_gram(geno.repartition(7), salts=5)
    key = ["family_id", "ti", "tj"]
    a, b = (t.filter("ti >= 0").toPandas().sort_values(key) for t in (a, b))
    assert list(a["payload"]) == list(b["payload"])


def test_tiles_equal_one_tile(spark):
    dosage, samples, *_ = panel(spark, per=10)
    geno = encode.pack(dosage, ("yield",))
    plan = folds.make_folds(samples)
    one, many = (gram.training_moments(gram.family_gram(geno, tile=t), plan).filter("held_out_family = 'P1_NAM01'").toPandas() for t in (512, 10))
    one, many = gram.Moments(one), gram.Moments(many)
    for name in ("a", "b", "c", "xy"):
        assert np.allclose(getattr(one, name), getattr(many, name))


def test_vanraden_fixture(spark):
    x = [[-1, -1, None], [0, -1, 1], [1, 1, -1], [0, 1, 0]]
    rows = [("A", f"s{i}", j, v) for i, r in enumerate(x) for j, v in enumerate(r)] + [("B", "t0", j, v) for j, v in enumerate([None, 1, 1])]
    dosage = spark.createDataFrame(rows, "family_id string, sample_id string, marker_pos int, dosage int")
    stats = markers.lofo_marker_stats(dosage, dosage.select("family_id", "sample_id").distinct()).filter("held_out_family = 'B'").orderBy("marker_pos").collect()
    assert [r["mean"] for r in stats] == [0.0, 0.0, 0.0] and [r["n_obs"] for r in stats] == [4, 4, 3]
    assert np.allclose([r["variance"] for r in stats], [0.5, 1.0, 0.5])
    z = markers.impute_center(dosage, markers.filter_blup(markers.lofo_marker_stats(dosage, dosage.select("family_id", "sample_id").distinct())))
    assert {r["marker_pos"]: r["z"] for r in z.filter("sample_id = 't0'").collect()} == {0: 0.0, 1: 1.0, 2: 1.0}


def test_reml_equals_a_dense_likelihood():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 12))
    z -= z.mean(0)
    y = z @ rng.normal(size=12) + rng.normal(size=40) * 2
    got = reml.fit_reml(z.T @ z, z.T @ y, 40, y.sum(), y @ y, 7.0)
    want = dense_fit(z @ z.T / 7.0 + reml.JITTER * np.eye(40), y)
    assert np.isclose(got["lambda_ratio"], want["lambda_ratio"], rtol=1e-3) and np.isclose(got["genetic_variance"], want["genetic_variance"], rtol=1e-3)
    assert np.isclose(got["intercept"], want["intercept"]) and np.allclose(got["beta"], z.T @ want["alpha"] / 7.0, atol=1e-4)


def test_ridge_equals_normal_equations(spark):
    """Predictions of a fold against ridge regression on components of the standardised training matrix."""
    dosage, samples, x, y, family = panel(spark, families=3, per=20, m=8, missing=0.0)
    oof, model = workloads.ridge_lofo(dosage, samples)
    got = oof.toPandas().set_index("sample_name")["predicted_yield_kg_ha"]
    best = model.toPandas().groupby("held_out_family").first()
    for f in range(3):
        train, test = family != f, family == f
        mean, std = x[train].mean(0), x[train].std(0)
        z, t = (x[train] - mean) / std, (x[test] - mean) / std
        n, target = train.sum(), (y[train] - y[train].mean()) / y[train].std()
        ridge_ = best.loc[f"P{f}_NAM{f:02d}", "ridge"] * n
        w = np.linalg.solve(z.T @ z + ridge_ * np.eye(8), z.T @ target)  # all 8 components are used
        names = [f"s{i:04d}" for i in np.flatnonzero(test)]
        assert np.allclose(got[names], y[train].mean() + y[train].std() * (t @ w), rtol=1e-6)


def test_ridge_uses_other_families_only(spark):
    dosage, samples, *_ = panel(spark, per=20)
    oof, model = workloads.ridge_lofo(dosage, samples)
    assert metrics.missing_predictions(oof).count() == 0
    rows = model.select("held_out_family", "validation_family").distinct().collect()
    assert all(r[0] != r[1] for r in rows) and len(rows) == 4
    p = oof.toPandas()
    assert np.corrcoef(p["observed_yield_kg_ha"], p["predicted_yield_kg_ha"])[0, 1] > 0.9


def test_components_match_svd(spark):
    dosage, samples, x, y, family = panel(spark, per=15, missing=0.0)
    got = ridge.pca_loadings(workloads.training(dosage, samples), 5).filter("held_out_family = 'P0_NAM00'").toPandas()
    t = x[family != 0]
    z = (t - t.mean(0)) / t.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    for c in range(5):
        own = got[got["component"] == c].sort_values("marker_pos")
        assert np.isclose(own["explained_variance"].iloc[0], s[c] ** 2 / (len(z) - 1))
        assert np.allclose(np.abs(own["loading"]), np.abs(vt[c]), atol=1e-6)


def test_pack_and_back(spark):
    dosage, *_ = panel(spark, families=2, per=3, m=5, missing=0.3)
    back = encode.unpack(encode.pack(dosage)).select("sample_id", "marker_pos", "dosage")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, dosage.select("sample_id", "marker_pos", "dosage").collect()), key=str)


def test_blocked_relationship(spark):
    dosage, samples, x, *_ = panel(spark, families=2, per=8, m=6, missing=0.2)
    geno = encode.pack(dosage).select("sample_pos", "dosages")
    mean = np.nanmean(x, 0)
    keep = np.ones(6, bool)
    k = gram.relationship_blocks(geno, geno, mean, keep, 2.0, block=5, jitter=0.1).toPandas()
    z = np.where(np.isfinite(x), x, mean) - mean
    got = np.zeros((16, 16))
    got[k["sample_i"], k["sample_j"]] = k["value"]
    assert np.allclose(got, z @ z.T / 2 + 0.1 * np.eye(16))


def test_too_few_families(spark):
    dosage, samples, *_ = panel(spark, families=1, per=5)
    with pytest.raises(ValueError):
        workloads.gblup_lofo(dosage, samples)


def test_components_to_a_share_of_variance(spark):
    dosage, samples, x, y, family = panel(spark, per=15, missing=0.0)
    training = workloads.training(dosage, samples)
    got = ridge.cumulative_variance(ridge.pca_loadings(training, 200)).filter("held_out_family = 'P0_NAM00'").toPandas().sort_values("component")
    t = x[family != 0]
    s = np.linalg.svd((t - t.mean(0)) / t.std(0), compute_uv=False) ** 2
    share = np.cumsum(s / s.sum())
    k = int(np.argmax(share >= 0.9)) + 1
    assert np.allclose(got["cumulative"], share) and got["used"].sum() == k and got["used"].iloc[:k].all()
    assert ridge.pca_to_variance(training).filter("held_out_family = 'P0_NAM00'").select("component").distinct().count() == k


def test_guards(spark):
    dosage, samples, *_ = panel(spark, families=3, per=6, m=4)
    from pyspark.sql import functions as F

    qc.require_trainable(samples, dosage)
    for s, d in ((samples.withColumn("yield", F.lit(1.0)), dosage), (samples.withColumn("yield", F.lit(float("inf"))), dosage), (samples, dosage.filter("family_id <> 'P1_NAM01' or marker_pos > 0")), (samples, dosage.withColumn("dosage", F.lit(7)))):
        with pytest.raises(qc.ValidationError):
            qc.require_trainable(s, d)
    for bad in ((1.1, 0.05, 0), (0.1, 0.6, 0), (0.1, 0.05, -1)):
        with pytest.raises(qc.ValidationError):
            qc.require_thresholds(*bad)


def test_split_digest_follows_samples_order_and_folds(spark):
    _, samples, *_ = panel(spark, families=4, per=5, m=2)
    from pyspark.sql import functions as F

    digest = lambda s, f, k="leave_one_family_out": folds.split_digest(s, f, k).first()[0]
    plan = folds.make_folds(samples)
    one = digest(samples, plan)
    assert one == digest(samples.repartition(7), plan.repartition(3)) and one.startswith("sha256:")
    moved = samples.withColumn("sample_pos", F.when(F.col("sample_pos") == 0, 1).when(F.col("sample_pos") == 1, 0).otherwise(F.col("sample_pos")))
    other = [digest(moved, plan), digest(samples.filter("sample_pos > 0"), plan), digest(samples, plan.filter("fold_index > 0")), digest(samples, plan, "random")]
    assert len({one, *other}) == 5
    oof = samples.select("family_id", F.col("sample_id").alias("sample_name"), F.col("yield").alias("observed_yield_kg_ha"), F.col("yield").alias("predicted_yield_kg_ha"))
    assert metrics.compare_models(oof, oof, folds.split_digest(samples, plan), folds.split_digest(samples, plan)).count() == 6
    with pytest.raises(ValueError, match="splits"):
        metrics.compare_models(oof, oof, folds.split_digest(samples, plan), folds.split_digest(moved, plan))


def graph_of(spark):
    import itertools

    edges = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 20)] + [(3, 3), (5, 4)], "u int, v int")
    weights = graph.smoothing_weights(graph.undirected(edges), spark.range(32).select(col("id").cast("int").alias("gene_id")))
    a = np.eye(32)
    for u, v in itertools.chain(((0, i) for i in range(1, 30)), ((i, i + 1) for i in range(1, 20))):
        a[u, v] = a[v, u] = 1
    d = a.sum(1)
    return weights, a / np.sqrt(np.outer(d, d))


@pytest.mark.parametrize("hops", [0, 1, 2, 3])
@pytest.mark.parametrize("part", [4, 4096])
def test_hops_are_powers_of_the_adjacency(spark, hops, part):
    weights, a = graph_of(spark)
    dosage, _, x, *_ = panel(spark, families=2, per=4, m=6, missing=0.2)
    genes = spark.createDataFrame([(0, 0), (1, 0), (2, 7), (3, 25), (4, 30), (5, 7)], "marker_pos int, gene_id int")
    operator = graph.smoothing_operator(genes, weights, hops, part)
    means = np.zeros((8, 32))
    filled = np.nan_to_num(x)
    for g in (0, 7, 25, 30):
        means[:, g] = filled[:, [m for m, q in ((0, 0), (1, 0), (2, 7), (3, 25), (4, 30), (5, 7)) if q == g]].mean(1)
    want = means @ np.linalg.matrix_power(a, hops).T
    got = np.zeros((8, 32))
    for r in graph.applied(dosage, operator).collect():
        got[int(r["sample_id"][1:]), r["gene_id"]] = r["x"]
    assert np.allclose(got, want)
    pooled = {int(r["sample_id"][1:]): r["pooled"] for r in graph.applied_pool(dosage, operator, spark.range(32)).collect()}
    assert np.allclose([pooled[i] for i in range(8)], want.mean(1))


def test_graph_queries_use_all_order_lines(spark, sf_dir):
    from lociframe.plans import registry
    from lociframe.sources import adapters

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = lines.filter("l_partkey <> l_suppkey").selectExpr("least(l_partkey, l_suppkey) a", "greatest(l_partkey, l_suppkey) b").distinct().count()
    assert graph.undirected(adapters.raw_edges(spark, sf_dir)).count() == 2 * pairs > 3000
    reached = registry.queries()["gene_smoothing"](spark, sf_dir).select("gene_id").distinct().count()
    assert reached > 32


def test_a_sample_named_as_its_nation_is_kept(spark):
    traits = spark.createDataFrame([("P15_NAM15", "15", 0, "3.5"), ("P15_NAM15", "P15", 1, "4.5")], "family_id string, sample_id string, sample_pos int, yield_raw string")
    calls = spark.createDataFrame([("P15_NAM15", "15", "m1", "A"), ("P15_NAM15", "P15", "m1", "B")], "family_id string, sample_id string, marker_id string, call string")
    assert [r["sample_id"] for r in qc.align(traits, calls).collect()] == ["15"]


def test_hash_tree_finds_what_differs(spark):
    from pyspark.sql import functions as F

    rows = [(f, i, f"{f}{i}") for f, n in (("A", 300), ("B", 40), ("C", 1)) for i in range(n)]
    samples = spark.createDataFrame(rows, "family_id string, sample_pos long, sample_id string")
    plan = folds.make_folds(samples)
    tree = lambda s: folds.sample_tree(s, 8, 4).persist()
    one = tree(samples)
    root = lambda t, p=plan, k="leave_one_family_out": folds.tree_root(t, p, k).first()[0]
    assert root(one) == root(tree(samples.repartition(7))) and one.filter("family_id = 'A'").agg(F.max("level")).first()[0] == 3
    swapped = samples.withColumn("sample_id", F.when(F.col("sample_id") == "A17", "A18").when(F.col("sample_id") == "A18", "A17").otherwise(F.col("sample_id")))
    moved = samples.withColumn("family_id", F.when(F.col("sample_id") == "B39", "C").otherwise(F.col("family_id")))
    more = samples.filter("sample_id <> 'A299'").union(spark.createDataFrame([("A", 5000, "new")], samples.schema))
    places = lambda s: {tuple(r) for r in folds.tree_difference(one, tree(s), 8, 4).collect()}
    assert places(swapped) == {("A", 16, 23)} and places(moved) == {("B", 32, 39), ("C", 32, 39)} and places(more) == {("A", 296, 303), ("A", 5000, 5007)}
    roots = [root(t) for t in (one, tree(swapped), tree(moved))] + [root(one, plan.filter("fold_index > 0")), root(one, plan, "random")]
    assert len(set(roots)) == len(roots)
    assert folds.tree_difference(tree(samples.limit(0)), tree(samples.limit(0))).count() == 0
    oof = samples.select("family_id", F.col("sample_id").alias("sample_name"), F.col("sample_pos").cast("double").alias("observed_yield_kg_ha"), F.lit(1.0).alias("predicted_yield_kg_ha"))
    whole = folds.sample_tree(samples).persist()
    assert metrics.compare_models(oof, oof, tree_a=whole, tree_b=whole).count() == 5
    with pytest.raises(ValueError, match=r"'A', 0, 255"):
        metrics.compare_models(oof, oof, tree_a=whole, tree_b=folds.sample_tree(swapped).persist())


def test_smoothing_sums_where_a_sample_is(spark):
    weights, _ = graph_of(spark)
    dosage, *_ = panel(spark, families=2, per=4, m=6, missing=0.2)
    genes = spark.createDataFrame([(0, 0), (1, 0), (2, 7), (3, 25), (4, 30), (5, 7)], "marker_pos int, gene_id int")
    operator = graph.smoothing_operator(genes, weights, 1)
    rows = lambda df: {tuple(r)[:3]: r["x"] for r in df.collect()}
    want, dealt = rows(graph.applied(dosage, operator)), graph.applied(dosage, operator, 7)
    got = rows(dealt)
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want) and dealt.rdd.getNumPartitions() == 7


def test_duplicates_in_parts(spark):
    from lociframe.operators import qc

    df = spark.range(1000).selectExpr("id % 400 as a", "id % 2 as b")
    dealt = qc.duplicates(df, ["a", "b"], 9)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, qc.duplicates(df, ["a", "b"]).collect())) and dealt.rdd.getNumPartitions() == 9
