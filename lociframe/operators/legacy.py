"""The lenient preprocessing path: coercion instead of errors, statistics over all samples, z-scores within families."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociframe.functions.scalars import trait_of

from .encode import encode_calls_lenient
from .markers import filter_all_samples, keep_first, zscores


def lenient_samples(phenotype: DataFrame) -> DataFrame:
    """Samples with an id and a trait that parses; the first row of each id, in file order."""
    rows = phenotype.withColumn("yield", trait_of(F.col("yield_raw"))).drop("yield_raw").dropna(subset=["yield"]).filter("sample_id is not null and trim(sample_id) <> ''")
    return keep_first(rows, ["family_id", "sample_id"], ["sample_pos"])


def synced(samples: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of the samples that both sides have, with their traits, the first of each (sample, marker)."""
    once = keep_first(calls.withColumnRenamed("sample_pos", "call_pos"), ["family_id", "sample_id", "marker_pos"], ["call_pos"])
    return once.drop("call_pos").join(samples, ["family_id", "sample_id"])


def modelling_table(samples: DataFrame, calls: DataFrame) -> DataFrame:
    """family_id, sample_id, sample_pos, z, marker_pos, dosage of the markers that pass the all-sample filter."""
    dosage = encode_calls_lenient(synced(zscores(samples).drop("yield"), calls))
    kept = filter_all_samples(dosage).filter("retained").select("marker_pos")
    return dosage.join(kept, "marker_pos", "left_semi")
