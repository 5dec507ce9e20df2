"""Marker statistics of training sets, marker filters, imputation, association scans.

One pass gives the sums of every (family, marker); the training set of a fold is all families but one, so its sums are
the totals less that family's. Sums are of integers and exact, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lociframe.functions.scalars import allele_frequency, clipped, heterozygosity, minor

#: Thresholds of the marker filters.
BLUP_MIN_RATE, BLUP_MIN_VARIANCE, BLUP_MIN_MAF = 0.10, 1e-6, 0.05
FEATURE_MIN_RATE, FEATURE_MIN_VARIANCE, FEATURE_MIN_MAF = 0.9, 2.220446049250313e-16, 0.01


def family_marker_sums(dosage: DataFrame) -> DataFrame:
    """family_id, marker_pos, n_obs, s1, s2."""
    x = F.col("dosage").cast("bigint")
    return dosage.groupBy("family_id", "marker_pos").agg(F.count("dosage").alias("n_obs"), F.coalesce(F.sum(x), F.lit(0)).alias("s1"), F.coalesce(F.sum(x * x), F.lit(0)).alias("s2"))


def family_sizes(samples: DataFrame) -> DataFrame:
    return samples.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))


def with_statistics(sums: DataFrame) -> DataFrame:
    """sums (n, n_obs, s1, s2) with observed_rate, mean, variance of the imputed column, allele_freq and maf.

    The mean of a marker without calls is null.
    """
    mean = F.try_divide(F.col("s1"), F.col("n_obs"))
    out = sums.withColumn("observed_rate", F.col("n_obs") / F.col("n")).withColumn("mean", mean)
    variance = (F.col("s2") - F.coalesce(F.col("n_obs") * F.col("mean") * F.col("mean"), F.lit(0.0))) / F.col("n")
    p = allele_frequency(F.col("mean"))
    return out.withColumn("variance", variance).withColumn("allele_freq", p).withColumn("maf", minor(p))


def marker_stats(dosage: DataFrame, samples: DataFrame) -> DataFrame:
    """Statistics over all samples."""
    n = samples.agg(F.count(F.lit(1)).alias("n"))
    sums = family_marker_sums(dosage).groupBy("marker_pos").agg(*[F.sum(c).alias(c) for c in ("n_obs", "s1", "s2")])
    return with_statistics(sums.join(F.broadcast(n), F.lit(True)))


def lofo_marker_stats(dosage: DataFrame, samples: DataFrame) -> DataFrame:
    """Statistics of every fold's training set: held_out_family, marker_pos and with_statistics' columns."""
    sums, sizes = family_marker_sums(dosage), family_sizes(samples)
    totals = sums.groupBy("marker_pos").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n_obs", "s1", "s2")])
    size = sizes.agg(F.sum("n").alias("t_n"))
    # A (family, marker) pair without any row still makes a fold: its sums are zero.
    pairs = totals.join(F.broadcast(sizes.join(size, F.lit(True))), F.lit(True))
    own = pairs.join(sums, ["family_id", "marker_pos"], "left")
    less = [(F.col(f"t_{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("n_obs", "s1", "s2")]
    return with_statistics(own.select(F.col("family_id").alias("held_out_family"), "marker_pos", (F.col("t_n") - F.col("n")).alias("n"), *less))


def retained_blup() -> Column:
    return (F.col("observed_rate") > BLUP_MIN_RATE) & F.coalesce((F.col("variance") > BLUP_MIN_VARIANCE) & (F.col("maf") > BLUP_MIN_MAF), F.lit(False))


def filter_blup(stats: DataFrame) -> DataFrame:
    return stats.withColumn("retained", retained_blup())


def filter_feature(stats: DataFrame) -> DataFrame:
    """The feature variant: a marker without calls has mean 0, frequencies lie within 0 and 1."""
    out = stats.withColumn("mean", F.coalesce("mean", F.lit(0.0))).withColumn("allele_freq", clipped(allele_frequency(F.col("mean"))))
    out = out.withColumn("maf", minor(F.col("allele_freq")))
    keep = (F.col("observed_rate") >= FEATURE_MIN_RATE) & (F.col("maf") >= FEATURE_MIN_MAF) & (F.col("variance") > FEATURE_MIN_VARIANCE)
    return out.withColumn("retained", keep)


def filter_all_samples(dosage: DataFrame) -> DataFrame:
    """marker_pos, variance, allele_freq, maf, retained over all samples, missing taken as 0 (not for validation)."""
    x = F.coalesce(F.col("dosage").cast("int"), F.lit(0))
    stats = dosage.groupBy("marker_pos").agg(F.var_pop(x).alias("variance"), ((F.count_if(x == 1) + 0.5 * F.count_if(x == 0)) / F.count(F.lit(1))).alias("allele_freq"))
    out = stats.withColumn("maf", minor(F.col("allele_freq")))
    return out.withColumn("retained", (F.col("variance") > BLUP_MIN_VARIANCE) & (F.col("maf") > BLUP_MIN_MAF))


def require_markers(stats: DataFrame, fold: str = "held_out_family") -> None:
    bad = stats.groupBy(fold).agg(F.count_if("retained").alias("k")).filter("k = 0").limit(5).collect()
    if bad:
        raise ValueError(f"no marker is left in {[r[fold] for r in bad]}")


def vanraden_denominator(stats: DataFrame, fold: str = "held_out_family") -> DataFrame:
    """fold, denominator: 2 sum p (1 - p) over retained markers."""
    return stats.filter("retained").groupBy(fold).agg(F.sum(heterozygosity(F.col("allele_freq"))).alias("denominator"))


def fold_summary(stats: DataFrame, fold: str = "held_out_family") -> DataFrame:
    total = F.sum(F.when(F.col("retained"), heterozygosity(F.col("allele_freq"))))
    return stats.groupBy(fold).agg(F.count(F.lit(1)).alias("n_markers"), F.count_if("retained").alias("n_retained"), total.alias("denominator"), F.avg(F.when(F.col("retained"), F.col("maf"))).alias("mean_maf"))


def impute_center(dosage: DataFrame, stats: DataFrame, scale: bool = False) -> DataFrame:
    """z of held-out rows under their own fold's training statistics; a missing call gives exactly 0.

    dosage: family_id, marker_pos. With scale, z is divided by the deviation of the imputed training column.
    """
    use = stats.filter("retained").select(F.col("held_out_family").alias("family_id"), "marker_pos", "mean", "variance")
    z = F.coalesce(F.col("dosage") - F.col("mean"), F.lit(0.0))
    return dosage.join(use, ["family_id", "marker_pos"]).withColumn("z", z / F.sqrt("variance") if scale else z).drop("mean", "variance")


def zscores(samples: DataFrame, value: str = "yield", group: str = "family_id") -> DataFrame:
    """samples with z = (value - mean) / (population deviation + 1e-6) of their group."""
    stats = samples.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return samples.join(stats, group).withColumn("z", (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-6)).drop("_m", "_s")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of a group, null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def association_scan(dosage: DataFrame, first: int | None = None, trait: str = "z") -> DataFrame:
    """marker_pos, r of the markers' dosages (missing as 0) with the trait; of the first ones only if `first` is given."""
    x = F.coalesce(F.col("dosage").cast("double"), F.lit(0.0))
    return (dosage if first is None else dosage.filter(F.col("marker_pos") < first)).groupBy("marker_pos").agg(correlation(x, F.col(trait)).alias("r"))


def top_markers(scan: DataFrame, n: int = 1) -> DataFrame:
    return scan.orderBy(F.desc_nulls_last(F.abs("r")), "marker_pos").limit(n)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
