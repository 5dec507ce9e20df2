"""Sinks: predictions, run tables, modelling tables. Nothing half-written is ever visible under its final name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The columns of an out-of-fold prediction table.
OOF_COLUMNS = ["family_id", "sample_name", "observed_yield_kg_ha", "predicted_yield_kg_ha"]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _rename(fs, source, target) -> None:
    try:
        done = fs.rename(source, target)
    except Exception as e:  # what the file system raises, by way of the gateway
        raise OSError(f"{source} could not be renamed to {target}") from e
    if not done:
        raise OSError(f"{source} could not be renamed to {target}")


def publish(spark: SparkSession, staged: str, final: str, replace: bool) -> None:
    """Moves a staged folder to its final name; an existing one is replaced or is an error. If a move fails, the old
    one is put back and the error raised. A folder can't be replaced in one step: for a moment the old one is gone."""
    fs, path = _fs(spark, final)
    if fs.exists(path(final)):
        if not replace:
            fs.delete(path(staged), True)
            raise FileExistsError(final)
        old = f"{final}.old-{uuid.uuid4().hex}"
        _rename(fs, path(final), path(old))
        try:
            _rename(fs, path(staged), path(final))
        except Exception:
            _rename(fs, path(old), path(final))
            raise
        fs.delete(path(old), True)
    else:
        _rename(fs, path(staged), path(final))


def write_oof(df: DataFrame, path: str, kind: str = "csv") -> None:
    """The prediction table, families sorted and samples in the order of sample_pos if df has it (else by name), file by
    file; it takes the place of the one before as `publish` does."""
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    order = ["family_id", "sample_pos" if "sample_pos" in df.columns else "sample_name"]
    df.orderBy(*order).select(*OOF_COLUMNS).write.option("header", True).format(kind).save(staged)
    publish(df.sparkSession, staged, path, replace=True)


def write_run_tables(spark: SparkSession, output_dir: str, run_id: str, tables: dict[str, DataFrame]) -> str:
    """All tables of a run under <output_dir>/<run_id>, visible together or not at all; a run id is used once."""
    # What a crash leaves behind has a name of its own, so the run id stays free.
    final, staged = f"{output_dir}/{run_id}", f"{output_dir}/.tmp-{run_id}-{uuid.uuid4().hex}"
    fs, path = _fs(spark, final)
    if fs.exists(path(final)):
        raise FileExistsError(final)
    try:
        for name, df in tables.items():
            writer = df.write.mode("errorifexists")
            (writer.partitionBy("fold_index") if "fold_index" in df.columns else writer).parquet(f"{staged}/{name}")
    except Exception:
        fs.delete(path(staged), True)
        raise
    publish(spark, staged, final, replace=False)
    return final


def write_modelling_table(df: DataFrame, path: str) -> None:
    """The table by family; it takes the place of the one before as `publish` does."""
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.partitionBy("family_id").parquet(staged)
    publish(df.sparkSession, staged, path, replace=True)
