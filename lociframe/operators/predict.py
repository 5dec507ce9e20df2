"""Predictions of held-out samples: each is scored by the one fold that holds out its family."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .gram import decoded

#: Tasks that the rows of a family are dealt over; bytes of dosages decoded at a time.
PARTS, DECODED = 8, 1 << 22


def predict_long(dosage: DataFrame, effects: DataFrame) -> DataFrame:
    """family_id, sample_id, predicted: intercept plus the effects of imputed, centred dosages.

    dosage: a row for each sample and marker; effects: reml.EFFECTS. One join on (family, marker), summed before the
    shuffle on samples.
    """
    use = effects.filter("retained").select(F.col("held_out_family").alias("family_id"), "marker_pos", "mean", "beta", "intercept")
    z = F.coalesce(F.col("dosage") - F.col("mean"), F.lit(0.0))
    scored = dosage.select(F.col("family_id").cast("string").alias("family_id"), "sample_id", "marker_pos", "dosage").join(use, ["family_id", "marker_pos"])
    return scored.groupBy("family_id", "sample_id").agg((F.max("intercept") + F.sum(z * F.col("beta"))).alias("predicted"))


def pack_effects(effects: DataFrame) -> DataFrame:
    """held_out_family, intercept, effects, means (doubles of all markers as bytes; effects of markers not retained are 0) of
    long effects. A fold's rows are as many as there are markers."""
    value = F.when(F.col("retained"), F.col("beta")).otherwise(0.0)
    got = effects.groupBy("held_out_family").agg(F.max("intercept").alias("intercept"), F.array_sort(F.collect_list(F.struct("marker_pos", value.alias("b"), "mean"))).alias("v"))
    got = got.select("held_out_family", "intercept", F.col("v.b").alias("b"), F.col("v.mean").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pa.array([np.asarray(x.values if hasattr(x, "values") else x, float).tobytes() for x in batch.column(i)], pa.binary()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["held_out_family", "intercept", "effects", "means"])

    return got.mapInArrow(run, "held_out_family string, intercept double, effects binary, means binary")


def scored_rows(geno: DataFrame, coefficients: DataFrame, parts: int = PARTS) -> DataFrame:
    """family_id, sample_id, item, value: offset plus the products of a sample's imputed, centred dosages with the weights of
    each item of its own fold.

    geno: packed rows (family_id, sample_id, dosages); coefficients: held_out_family, item, offset, weights, means (doubles
    as bytes). Both go to (family, part), a family's rows dealt over `parts` tasks; the weights of a fold come before its rows,
    which stream by. A task holds the weights of one fold, and no row for each cell is made.
    """
    fold = coefficients.select(
        F.col("held_out_family").cast("string").alias("family_id"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col("item").cast("int").alias("item"),
        F.lit(None).cast("string").alias("sample_id"), F.col("offset").cast("double").alias("offset"), F.col("weights").alias("a"), F.col("means").alias("b"),
    )
    name = F.col("sample_id").cast("string")
    rows = geno.select(
        F.col("family_id").cast("string").alias("family_id"), F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("int").alias("item"),
        name.alias("sample_id"), F.lit(None).cast("double").alias("offset"), F.col("dosages").alias("a"), F.lit(None).cast("binary").alias("b"),
    )
    both = fold.unionByName(rows).repartition("family_id", "part").sortWithinPartitions("family_id", "part", F.asc_nulls_last("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items, offsets, weights, means, ready = None, [], [], [], [], None

        def answered(family: str, samples: list[str], dosages: list[bytes]) -> Iterator[pa.RecordBatch]:
            step = max(1, DECODED // max(len(dosages[0]), 1))
            for lo in range(0, len(dosages), step):
                x, o = decoded(dosages[lo : lo + step])
                w, shifted, offset = ready
                value = x @ w - o @ shifted + offset
                n, k = value.shape
                names = np.repeat(np.array(samples[lo : lo + step], object), k)
                yield pa.RecordBatch.from_arrays([pa.array([family] * (n * k)), pa.array(names, pa.string()), pa.array(np.tile(items, n).astype(np.int32)), pa.array(value.ravel())], names=["family_id", "sample_id", "item", "value"])

        for batch in batches:
            families, part, item, samples, offset, a, b = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(families):
                if (families[i], part[i]) != key:
                    key, items, offsets, weights, means, ready = (families[i], part[i]), [], [], [], [], None
                if item[i] is not None:
                    items.append(item[i])
                    offsets.append(offset[i])
                    weights.append(np.frombuffer(a[i]))
                    means.append(np.frombuffer(b[i]))
                    i += 1
                    continue
                j = i
                while j < len(families) and (families[j], part[j]) == key:
                    j += 1
                if items:  # rows of a family that no fold holds out have no score
                    if ready is None:
                        w = np.stack(weights, 1)
                        ready = (w, np.stack(means, 1) * w, np.array(offsets))
                    yield from answered(families[i], samples[i:j], a[i:j])
                i = j

    return both.mapInArrow(run, "family_id string, sample_id string, item int, value double")


def predict_packed(geno: DataFrame, effects: DataFrame, parts: int = PARTS) -> DataFrame:
    """As predict_long, from packed rows and packed effects (pack_effects, or what krylov gives)."""
    items = effects.select("held_out_family", F.lit(0).alias("item"), F.col("intercept").alias("offset"), F.col("effects").alias("weights"), "means")
    return scored_rows(geno, items, parts).select("family_id", "sample_id", F.col("value").alias("predicted"))


def project_packed(geno: DataFrame, components: DataFrame, parts: int = PARTS) -> DataFrame:
    """As project, from packed rows and krylov.COMPONENT."""
    items = components.select("held_out_family", F.col("component").alias("item"), F.lit(0.0).alias("offset"), "weights", "means")
    return scored_rows(geno, items, parts).select("family_id", "sample_id", F.col("item").alias("component"), F.col("value").alias("score"))


def oof_table(samples: DataFrame, predicted: DataFrame, ordered: bool = False) -> DataFrame:
    """The four columns of an out-of-fold table, one row for each sample; a sample without prediction has a null one. Ordered,
    sample_pos comes with it, by which sinks put samples in the order of their file."""
    joined = samples.withColumn("family_id", F.col("family_id").cast("string")).join(predicted, ["family_id", "sample_id"], "left")
    columns = ["family_id", F.col("sample_id").alias("sample_name"), F.col("yield").alias("observed_yield_kg_ha"), F.col("predicted").alias("predicted_yield_kg_ha")]
    return joined.select(*columns, *(["sample_pos"] if ordered else []))


def project(z: DataFrame, loadings: DataFrame) -> DataFrame:
    """family_id, sample_id, component, score: standardised rows times loadings (held_out_family, marker_pos, component, loading)."""
    use = loadings.withColumnRenamed("held_out_family", "family_id")
    return z.join(use, ["family_id", "marker_pos"]).groupBy("family_id", "sample_id", "component").agg(F.sum(F.col("z") * F.col("loading")).alias("score"))


def fold_results(effects: DataFrame, metrics: DataFrame, folds: DataFrame) -> DataFrame:
    """fold_index, held_out_family, r, rmse, fitted variances and retained markers: one row for each fold."""
    fits = effects.groupBy("held_out_family").agg(*[F.first(c).alias(c) for c in ("lambda_ratio", "genetic_variance", "residual_variance", "n_retained", "n_train")])
    plan = folds.select("fold_index", F.col("held_out_family").cast("string").alias("held_out_family"))
    return plan.join(fits, "held_out_family").join(metrics.select(F.col("family_id").alias("held_out_family"), "r", "rmse"), "held_out_family")


def equation_gaps(dosage: DataFrame, effects: DataFrame) -> DataFrame:
    """held_out_family, n_train, n_retained, gap: how far the effects of each fold are from solving its equations, the largest
    |z_j'(y - intercept - Z beta) - penalty_j beta_j| over the largest |z_j'(y - intercept)|.

    dosage: a row for each sample and marker with its yield; effects: long, with penalty. A check for small panels: rows of
    dosage are repeated for each fold.
    """
    use = effects.filter("retained").select("held_out_family", "marker_pos", "mean", "beta", "intercept", "penalty")
    train = dosage.select(F.col("family_id").cast("string").alias("family_id"), "sample_id", "marker_pos", "dosage", F.col("yield").cast("double").alias("y"))
    rows = train.join(use, "marker_pos").filter(F.col("family_id") != F.col("held_out_family")).withColumn("z", F.coalesce(F.col("dosage") - F.col("mean"), F.lit(0.0)))
    key = ["held_out_family", "family_id", "sample_id"]
    fitted = rows.groupBy(*key).agg(F.sum(F.col("z") * F.col("beta")).alias("f"))
    left = rows.join(fitted, key).withColumn("e", F.col("y") - F.col("intercept"))
    by = left.groupBy("held_out_family", "marker_pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * (F.col("e") - F.col("f"))).alias("own"), F.max(F.col("penalty") * F.col("beta")).alias("want"), F.sum(F.col("z") * F.col("e")).alias("size")
    )
    return by.groupBy("held_out_family").agg(F.max("n").alias("n_train"), F.count(F.lit(1)).alias("n_retained"), (F.max(F.abs(F.col("own") - F.col("want"))) / F.max(F.abs("size"))).alias("gap"))
