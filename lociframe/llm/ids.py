"""Rows of a table by a set of ids, without shuffling the rows that are surely not (or surely) wanted.

The set is folded into a bitmap of BITS bits, whatever its size, which rows pass in the scan; what hits it is joined to the
ids. So the result never depends on the bitmap: the fuller it gets, the more rows take part in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import fresh
from .text import U64, mix

_LOG = 23
BITS = 1 << _LOG


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) >> U64(64 - _LOG)).astype(np.int64)


class IdFilter:
    """May tell that an id is in the set though it is not; never the reverse. Null ids are never in it."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed  # uint8, BITS / 8 of them

    def hits(self, ids: pa.Array) -> np.ndarray:
        np.seterr(over="ignore")
        at = _slots(ids.fill_null(0).to_numpy(zero_copy_only=False))
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)


def id_filter(ids: DataFrame) -> IdFilter:
    """ids: one column of longs. The driver gets BITS / 64 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[_slots(batch.column(0).drop_null().to_numpy(zero_copy_only=False))] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["word", "bits"])

    out = np.zeros(BITS // 64, np.int64)
    for r in ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return IdFilter(out.view(np.uint8))


def _side(df: DataFrame, key: str, found: IdFilter, hit: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = found.hits(batch.column(batch.num_columns - 1))
            rows = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            yield rows.filter(pa.array(mask if hit else ~mask))

    return df.withColumn(fresh(df, "_id"), F.col(key).cast("bigint")).mapInArrow(run, df.schema)


def split_rows(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key is surely not among ids (null keys too), and the rows that have to be joined to tell."""
    found = id_filter(ids)
    return _side(df, key, found, False), _side(df, key, found, True)


def rows_without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is not among ids (distinct longs, one column); rows with a null key stay."""
    clear, rest = split_rows(df, ids, key)
    name = fresh(df, "_gone")
    gone = ids.toDF(name)
    return clear.unionByName(rest.join(gone, rest[key].cast("bigint") == gone[name], "left_anti"))


def rows_with(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among ids (longs, one column)."""
    name = fresh(df, "_wanted")
    rest = split_rows(df, ids, key)[1]
    wanted = ids.toDF(name)
    return rest.join(wanted, rest[key].cast("bigint") == wanted[name], "left_semi")


def unique_rows(docs: DataFrame) -> DataFrame:
    """docs (id, t) with one row for each id that is not null: of rows that repeat an id, the one of least text."""
    docs = docs.filter("id is not null")
    twice = docs.groupBy("id").count().filter("count > 1").select("id")
    if not twice.limit(1).count():
        return docs
    again = rows_with(docs, twice, "id").groupBy("id").agg(F.min("t").alias("t"))
    return rows_without(docs, twice, "id").unionByName(again)
