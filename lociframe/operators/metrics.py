"""Prediction metrics of out-of-fold tables and comparisons of two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .folds import tree_difference

#: Fixed value: a range of observed or predicted values up to this counts as constant.
EPSILON = 2.220446049250313e-16


def _is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def pearson(o: Column, p: Column, constant: float | None = 0.0) -> Column:
    """Aggregate: correlation over rows with both sides finite. Fewer than two such rows: NaN; a constant side: `constant`."""
    both = _is_finite(o) & _is_finite(p)
    x, y = F.when(both, o.cast("double")), F.when(both, p.cast("double"))
    flat = (F.max(x) - F.min(x) <= EPSILON) | (F.max(y) - F.min(y) <= EPSILON)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(x) < 2, float("nan")).when(flat, F.lit(constant).cast("double")).otherwise(r)


def rmse(o: Column, p: Column) -> Column:
    return F.sqrt(F.avg((o - p) * (o - p)))


def fold_metrics(oof: DataFrame, o: str = "observed_yield_kg_ha", p: str = "predicted_yield_kg_ha", fold: str = "family_id") -> DataFrame:
    """fold, n, r, rmse."""
    return oof.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(o), F.col(p)).alias("r"), rmse(F.col(o), F.col(p)).alias("rmse"))


def metric_summary(oof: DataFrame, o: str = "observed_yield_kg_ha", p: str = "predicted_yield_kg_ha", fold: str = "family_id") -> DataFrame:
    """Rows (scope, fold, n, r, rmse): each fold, macro (mean of the folds) and pooled, from one pass over the table.

    Grouping sets give the folds and the pooled row; a NaN fold is skipped in the macro mean.
    """
    both = oof.groupingSets([[fold], []], fold).agg(
        F.grouping(fold).alias("g"), F.count(F.lit(1)).alias("n"), pearson(F.col(o), F.col(p)).alias("r"), rmse(F.col(o), F.col(p)).alias("rmse")
    )
    rows = both.select(F.when(F.col("g") == 1, "pooled").otherwise("fold").alias("scope"), F.col(fold).cast("string").alias("fold"), "n", "r", "rmse")
    macro = rows.filter("scope = 'fold'").agg(F.sum("n").alias("n"), F.avg(F.nanvl("r", F.lit(None).cast("double"))).alias("r"), F.avg("rmse").alias("rmse"))
    return rows.unionByName(macro.select(F.lit("macro").alias("scope"), F.lit(None).cast("string").alias("fold"), "n", "r", "rmse"))


def mean_scores(scores: DataFrame, model: str, score: str) -> DataFrame:
    """model, mean of its scores; NaN ones are skipped."""
    return scores.groupBy(model).agg(F.avg(F.nanvl(F.col(score), F.lit(None).cast("double"))).alias("mean_score"), F.count_if(~F.isnan(score)).alias("n_scores"))


def improvement(means: DataFrame, model: str, a, b) -> DataFrame:
    """One row: mean score of model a less that of b."""
    pick = lambda m: F.max(F.when(F.col(model) == m, F.col("mean_score")))
    return means.agg((pick(a) - pick(b)).alias("improvement"))


def target_scale(samples: DataFrame, value: str = "yield") -> DataFrame:
    """held_out_family, mean, scale of the training trait of every fold: total sums less the family's own."""
    y = F.col(value).cast("double")
    own = samples.groupBy("family_id").agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    every = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    n, s, q = F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tq") - F.col("q")
    both = own.join(F.broadcast(every), F.lit(True)).select("family_id", n.alias("n"), F.try_divide(s, n).alias("mean"), F.try_divide(q, n).alias("q"))
    return both.select(F.col("family_id").alias("held_out_family"), "n", "mean", F.sqrt(F.greatest(F.col("q") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("scale"))


def family_summary(samples: DataFrame, value: str = "yield") -> DataFrame:
    return samples.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_samples"), F.avg(value).alias("mean_trait"))


def correlation_loss(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, loss: the negative correlation with small constants under the roots and in the denominator."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    n = F.count(F.lit(1))
    sxy, sxx, syy = F.covar_pop(x, y) * n, F.var_pop(x) * n, F.var_pop(y) * n
    return rows.groupBy(group).agg((-sxy / (F.sqrt(sxx + 1e-8) * F.sqrt(syy + 1e-8) + 1e-8)).alias("loss"))


def missing_predictions(oof: DataFrame) -> DataFrame:
    """Samples without one finite prediction: absent, not finite, or there more than once."""
    ok = _is_finite(F.col("predicted_yield_kg_ha"))
    per = oof.groupBy("family_id", "sample_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("finite"))
    return per.filter("n <> 1 or finite <> 1")


def compare_models(a: DataFrame, b: DataFrame, split_a: DataFrame | None = None, split_b: DataFrame | None = None, tree_a: DataFrame | None = None, tree_b: DataFrame | None = None) -> DataFrame:
    """Rows (scope, fold, r_a, r_b, r_difference, rmse_a, rmse_b, rmse_difference) of two tables over the same samples.

    split_a, split_b: one-row tables with the split_digest of each run; if given, they must be equal. With the hash trees of
    their samples (folds.sample_tree), an error names the families and places that differ.
    """
    if tree_a is not None and tree_b is not None:
        if places := tree_difference(tree_a, tree_b).orderBy("family_id", "first_place").limit(5).collect():
            raise ValueError(f"the tables come from different splits: samples differ in {[(r['family_id'], r['first_place'], r['last_place']) for r in places]}")
    if split_a is not None or split_b is not None:
        digests = [s.select("split_digest").first() if s is not None else None for s in (split_a, split_b)]
        if None in digests or digests[0] != digests[1]:
            raise ValueError(f"the tables come from different splits: {digests}")
    keys = ["family_id", "sample_name"]
    left, right = a.select(*keys).withColumn("_a", F.lit(1)), b.select(*keys).withColumn("_b", F.lit(1))
    lonely = left.join(right, keys, "full_outer").filter("_a is null or _b is null").limit(5).collect()
    if lonely:
        raise ValueError(f"the tables do not hold the same samples: {[(r['family_id'], r['sample_name']) for r in lonely]}")
    x, y = (metric_summary(t).select("scope", "fold", F.col("r").alias(f"r_{n}"), F.col("rmse").alias(f"rmse_{n}")) for t, n in ((a, "a"), (b, "b")))
    y = y.withColumnsRenamed({"scope": "s2", "fold": "f2"})
    both = x.join(y, (F.col("scope") == F.col("s2")) & F.col("fold").eqNullSafe(F.col("f2")))
    return both.select("scope", "fold", "r_a", "r_b", (F.col("r_a") - F.col("r_b")).alias("r_difference"), "rmse_a", "rmse_b", (F.col("rmse_a") - F.col("rmse_b")).alias("rmse_difference"))
