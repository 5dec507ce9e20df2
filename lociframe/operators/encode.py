"""Calls to dosages, long rows to packed ones and back. A missing dosage is null in long rows, -128 in packed ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lociframe.functions.scalars import dosage_of

MISSING = -128


def encode_calls(calls: DataFrame) -> DataFrame:
    """call becomes dosage (-1, 0, 1 or null)."""
    return calls.withColumn("dosage", dosage_of(F.col("call"))).drop("call")


def encode_calls_lenient(calls: DataFrame) -> DataFrame:
    """Missing and unknown calls are 0."""
    return calls.withColumn("dosage", F.coalesce(dosage_of(F.col("call")), F.lit(0).cast("tinyint"))).drop("call")


def pack(dosage: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """family_id, sample_id, sample_pos, extra and dosages (one byte for each marker, in marker order) by sample.

    A sample's rows are as many as there are markers, so the group is bounded by the panel.
    """
    keys = ["family_id", "sample_id", "sample_pos", *extra]
    byte = F.coalesce(F.col("dosage").cast("int"), F.lit(MISSING))
    got = dosage.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("marker_pos", byte.alias("d")))).alias("v"))
    return _to_bytes(got.select(*keys, F.col("v.d").alias("_d")), keys)


def _to_bytes(df: DataFrame, keys: list[str]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]) + ", dosages binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            raw = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int8).tobytes()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            parts = [raw[s:e] for s, e in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(parts, pa.binary())], names=[*keys, "dosages"])

    return df.mapInArrow(run, schema)


def unpack(geno: DataFrame) -> DataFrame:
    """One row for each sample and marker position, dosage null where missing."""
    n = F.octet_length("dosages")
    byte = lambda i: F.conv(F.hex(F.substring("dosages", i + 1, F.lit(1))), 16, 10).cast("int")
    values = F.transform(F.sequence(F.lit(0), n - 1), lambda i: byte(i))
    rows = geno.filter(n > 0).select(*[c for c in geno.columns if c != "dosages"], F.posexplode(values).alias("marker_pos", "b"))
    signed = F.when(F.col("b") > 127, F.col("b") - 256).otherwise(F.col("b"))
    return rows.withColumn("dosage", F.when(signed != MISSING, signed).cast("tinyint")).drop("b")
