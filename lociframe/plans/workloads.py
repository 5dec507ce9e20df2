"""The three workloads: GBLUP leave-one-family-out, nested ridge on components, lenient preprocessing."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from lociframe.operators import encode, folds, gram, graph, krylov, legacy, markers, metrics, predict, qc, reml, ridge
from lociframe.sources import readers, sinks


def load_strict(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, modelled samples (with traits) and dosages of a directory of family files; raises on any violation. Genotype
    files are read once: their cells are kept on disk for checks and encoding."""
    files = readers.list_family_files(spark, data_dir)
    cells = readers.read_genotypes(spark, files).persist(StorageLevel.DISK_ONLY)
    phenotype, headers, calls = readers.read_phenotypes(spark, files), readers.genotype_headers(cells), readers.genotype_calls(cells)
    qc.assert_valid(qc.validate(phenotype, headers, calls))
    samples = qc.strict_traits(qc.without_founders(phenotype))
    return files, samples, encode.encode_calls(qc.align(phenotype, calls))


def training(dosage: DataFrame, samples: DataFrame, seed: int | None = None) -> DataFrame:
    """Moments of every fold's training set; with a seed, of its selection and validation sets too."""
    geno = encode.pack(dosage, ("yield",))
    plan = folds.make_folds(samples)
    folds.require_folds(plan)
    if seed is not None:
        plan = folds.validation_families(plan, seed)
    plan = plan.withColumn("held_out_family", F.col("held_out_family").cast("string"))
    return gram.training_moments(gram.family_gram(geno), plan)


def gblup_lofo(dosage: DataFrame, samples: DataFrame, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and the effects they come from."""
    effects = reml.fit_lofo(training(dosage, samples))
    return predict.oof_table(samples, predict.predict_packed(encode.pack(dosage), predict.pack_effects(effects)), ordered), effects


def ridge_lofo(dosage: DataFrame, samples: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    plan = folds.validation_families(folds.make_folds(samples), seed)
    model = ridge.fit_nested(training(dosage, samples, seed), plan)
    return predict.oof_table(samples, predict.predict_packed(encode.pack(dosage), predict.pack_effects(model))), model


def gblup_lofo_large(geno: DataFrame, samples: DataFrame, **settings) -> tuple[DataFrame, DataFrame]:
    """gblup_lofo for panels of any number of markers (krylov.reml_large) from packed rows (family_id, sample_id, dosages,
    yield), which are read once a step and should be stored or persisted."""
    plan = folds.make_folds(samples)
    folds.require_folds(plan)
    effects = krylov.reml_large(geno, plan, **settings)
    return predict.oof_table(samples, predict.predict_packed(geno, effects)), effects


def ridge_lofo_large(geno: DataFrame, samples: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """ridge_lofo on all components (krylov.ridge_large), from packed rows as above."""
    plan = folds.validation_families(folds.make_folds(samples), seed)
    model = krylov.ridge_large(geno, plan)
    return predict.oof_table(samples, predict.predict_packed(geno, model)), model


def run_gblup(spark: SparkSession, data_dir: str, output_dir: str, run_id: str) -> str:
    """The whole GBLUP run on files: read, check, fit, predict, score, verify the inputs, publish."""
    files, samples, dosage = load_strict(spark, data_dir)
    qc.require_thresholds(markers.BLUP_MIN_RATE, markers.BLUP_MIN_MAF, markers.BLUP_MIN_VARIANCE)
    qc.require_trainable(samples, dosage)
    # A row for each family, taken to the driver: a recomputed one would describe files that may have changed.
    found = readers.describe_input_files(spark, files)
    manifest = spark.createDataFrame(found.collect(), found.schema)
    oof, effects = gblup_lofo(dosage, samples, ordered=True)
    oof, effects = oof.cache(), effects.cache()
    if metrics.missing_predictions(oof).limit(1).count():
        raise ValueError("not every sample has one finite prediction")
    summary = metrics.metric_summary(oof)
    results = predict.fold_results(effects, metrics.fold_metrics(oof), folds.make_folds(samples))
    readers.verify_inputs_unchanged(readers.describe_input_files(spark, files), manifest)
    tables = {"oof": oof.select(*sinks.OOF_COLUMNS), "metrics": summary, "folds": results, "fold_markers": effects, "input_manifest": manifest, "split": folds.split_digest(samples, folds.make_folds(samples))}
    final = sinks.write_run_tables(spark, output_dir, run_id, tables)
    sinks.write_oof(oof, f"{output_dir}/oof_predictions")
    return final


def lenient_features(samples: DataFrame, calls: DataFrame, marker_genes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Modelling table, association scan and pooled gene features of the lenient path."""
    table = legacy.modelling_table(samples, calls)
    scan = markers.association_scan(table)
    genes = graph.gene_list(marker_genes)
    features = graph.smoothed(graph.gene_means(table, marker_genes), graph.smoothing_weights(graph.undirected(edges), genes))
    return table, scan, graph.pooled(features)
