"""Reading files in tasks piece by piece: numbered lines, digests, row ranges of a binary matrix. No file is ever one row."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from lociframe.functions.scalars import base_name, family_of_file

#: Bytes read at a time; bytes of matrix rows of one task.
PIECE, RANGE = 4 << 20, 64 << 20


def _opened(path: str, seek: bool = False) -> pa.NativeFile:
    """A file as a stream, or with seek; the file system is that of the path's scheme (s3a is s3)."""
    path = re.sub(r"^s3a://", "s3://", re.sub(r"^file:/+", "file:///", path))
    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_file(inner) if seek else store.open_input_stream(inner, compression=None)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """family_id, line_pos, line (without its end) of gzipped files, in order; line 0 is the header, empty lines are left out.

    Spark's text reader streams a gzip file line by line in one task, whatever its size; lines are numbered as they pass,
    and a batch holds a bounded number of bytes, or one line.
    """
    text = spark.read.text(paths, lineSep="\n").select(family_of_file(base_name(F.col("_metadata.file_path"))).alias("family_id"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            families, kept, places = batch.column(0).to_pylist(), [], []
            for i, family in enumerate(families):
                now, n = (now, n + 1) if family == now else (family, 0)
                kept.append(i)
                places.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), batch.column(1)], names=["family_id", "line_pos", "line"])

    lines = text.mapInArrow(run, "family_id string, line_pos long, line string")
    return lines.withColumn("line", F.regexp_replace("line", "\r$", "")).filter(F.col("line") != "")


CELLS = "family_id string, marker_pos long, marker string, sample_pos int, sample string, call string"


def melted(lines: DataFrame) -> DataFrame:
    """CELLS of numbered lines of genotype files: a row for each cell, and with marker_pos -1 one for each name in the header
    (sample_pos -1 and no name if it has none). Lines of a file must come in order from its first one, as numbered_lines
    gives them: the header stays with the task, and no row carries it.

    A cell beyond the header's names has an empty one; a line that is shorter has fewer rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def rows() -> pa.RecordBatch:
                counts = [len(h[3]) for h in held]
                at = np.repeat(np.arange(len(held)), counts)
                pick = lambda k, t: pa.array([h[k] for h in held], t).take(pa.array(at))
                flat = lambda k: pa.array([x for h in held for x in h[k]], pa.string())
                places = np.concatenate([h[5] for h in held]).astype(np.int32)
                return pa.RecordBatch.from_arrays([pick(0, pa.string()), pick(1, pa.int64()), pick(2, pa.string()), pa.array(places), flat(3), flat(4)], names=["family_id", "marker_pos", "marker", "sample_pos", "sample", "call"])

            for family, place, line in zip(*(c.to_pylist() for c in batch.columns)):
                cells = line.split("\t")
                if place == 0:
                    names = cells[1:]
                    held.append((family, -1, None, names or [None], [None] * max(len(names), 1), np.arange(len(names)) if names else np.array([-1])))
                else:
                    own = cells[1:]
                    held.append((family, place - 1, cells[0], (names + [""] * (len(own) - len(names)))[: len(own)], own, np.arange(len(own))))
                size += len(line)
                if size > PIECE:
                    yield rows()
                    held, size = [], 0
            if held:
                yield rows()

    return lines.mapInArrow(run, CELLS)


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256 of each file, PIECE bytes at a time, a task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with _opened(path) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "sha256"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1)).mapInArrow(run, "path string, sha256 string")


def matrix_shape(path: str) -> tuple[int, int, int]:
    """Rows, columns and first byte of the values of a .npy file of int8 by rows; raises ValueError for another one."""
    with _opened(path, seek=True) as f:
        version = np.lib.format.read_magic(f)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"{path}: matrix format {version} is not known")
        shape, by_columns, kind = read(f)
        if kind != np.int8 or len(shape) != 2 or by_columns and min(shape) > 1:
            raise ValueError(f"{path}: not a matrix of int8 by rows but {kind} of shape {shape}{' by columns' if by_columns else ''}")
        return shape[0], shape[1], f.tell()


def matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """sample_pos and dosages (bytes of a row) of a .npy matrix of int8; a task reads a range of rows of about RANGE bytes."""
    n, m, first = matrix_shape(path)
    each = max(1, RANGE // max(m, 1))
    starts = [(i, min(i + each, n)) for i in range(0, n, each)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(path, seek=True) as f:
                    f.seek(first + lo * m)
                    for i in range(lo, hi, max(1, PIECE // max(m, 1))):
                        j = min(i + max(1, PIECE // max(m, 1)), hi)
                        data = f.read((j - i) * m)
                        if len(data) < (j - i) * m:
                            raise ValueError(f"{path} ends before row {j}")
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, j)), pa.array([data[k * m : (k + 1) * m] for k in range(j - i)], pa.binary())], names=["sample_pos", "dosages"])

    ranges = spark.createDataFrame(starts, "lo long, hi long").repartition(max(len(starts), 1))
    return ranges.mapInArrow(run, "sample_pos long, dosages binary")
