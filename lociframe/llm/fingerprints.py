"""Threshold-scaled fingerprints: the shingle hashes below a fixed fraction of the hash range.

A fingerprint is the sorted set of kept hashes, so fingerprints of parts merge by set union, and the containment of
one document in another is estimated however unequal they are. Shingles are runs of five words; a text of fewer words
is one shingle. The smallest hash is always kept, so that a text with words never has an empty fingerprint; only in that
case (no hash below the threshold) is a fingerprint not the plain set of small hashes, and a union of parts may then hold
one hash more than the fingerprint of the whole. Kept hashes are 31 bits wide: two of a union of a million collide with a
chance of about 2e-4 each. A smallest hash that is not below the fraction has a bit of its own, so it is never taken for one.

Defined edge cases: a null text is an empty one, with the empty fingerprint; two empty fingerprints are alike (1), an
empty and another one are not (0). Repeated ids stand next to each other in the order of documents; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import table
from .text import chunks, shingles

#: Words in a shingle; one hash in SCALE is kept.
WORDS, SCALE = 5, 8


def scaled_sets(col: pa.Array, words: int = WORDS, scale: int = SCALE) -> Iterator[np.ndarray]:
    """Kept hashes of each text: distinct, sorted, 31 bits of each by their size below the limit; a smallest hash above it has
    bit 31 and its upper 31 bits."""
    limit = np.uint64((2**64 - 1) // scale)
    shift = np.uint64(64 - (scale.bit_length() - 1) - 31)
    for c in chunks(col):
        h, offsets = shingles(c.hashes, c.words, words)
        keep = h <= limit
        keep_at = np.concatenate(([0], np.cumsum(keep)))[offsets]
        kept = np.minimum(h[keep] >> shift, np.uint64(2**31 - 1)).astype(np.uint32)
        for i in range(c.hi - c.lo):
            own = kept[keep_at[i] : keep_at[i + 1]]
            if not len(own) and offsets[i + 1] > offsets[i]:
                own = (h[offsets[i] : offsets[i + 1]].min(keepdims=True) >> np.uint64(33)).astype(np.uint32) | np.uint32(1 << 31)
            yield np.unique(own)


def encoded(kept: np.ndarray) -> str:
    return base64.b64encode(kept.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two kept sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [x.split()[0] for x in RESULT.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in RESULT.split(", ")])


def edit_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its copy whose second half is taken from the next document by descending key.

    The keys are cut into as many ranges as there are shuffle partitions; each range is one sorted stream, and the
    first row of a range also goes to the end of the range before it. One shuffle of the texts; the driver sees the
    bounds of the ranges and one key for each.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)))
    key_of = F.coalesce(F.col("k"), F.lit(-(2**63)))
    ranges = F.lit(0)
    if bounds:
        ranges = F.expr(f"size(filter(array({','.join(f'{int(b)}L' for b in bounds)}), b -> b < k))")
    placed = docs.select("k", "t", F.coalesce(ranges, F.lit(0)).alias("r"))
    # The first row of each range, in descending order, is what ends the range above it.
    heads = {x["r"]: x["k"] for x in placed.groupBy("r").agg(F.max(key_of).alias("k")).collect()}
    order = sorted(heads)
    above = {heads[r]: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    if above:
        lent = F.create_map(*[F.lit(x) for kv in above.items() for x in kv])
        placed = placed.withColumn("to", F.array_compact(F.array(F.struct("r", F.lit(0).alias("lent")), F.when(lent[key_of].isNotNull(), F.struct(lent[key_of].alias("r"), F.lit(1).alias("lent"))))))
        placed = placed.select("k", "t", F.inline("to"))
    else:
        placed = placed.withColumn("lent", F.lit(0))
    ordered = placed.repartition(n, "r").sortWithinPartitions("r", "lent", F.desc_nulls_last("k"), F.xxhash64("t"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held = None  # (key, text, kept set, range, lent) of the row whose next one is still to come
        for batch in batches:
            kept = scaled_sets(batch.column(1))
            pairs, size = [], 0
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), kept, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if held is not None and held[3] == row[3] and not held[4]:
                    pairs.append((held, row))
                    size += len(held[1])
                held = row
                if size > 2 << 20:
                    yield result(pairs)
                    pairs, size = [], 0
            yield result(pairs)

    def result(pairs: list) -> pa.RecordBatch:
        edited = [(a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2]) for a, b in pairs]
        sets = scaled_sets(pa.array(edited, pa.string()))
        rows = [
            (a[0], len(a[1]), hashlib.sha256(e.encode()).hexdigest(), encoded(a[2]), encoded(s), likeness(a[2], s), likeness(a[2], b[2]))
            for (a, b), e, s in zip(pairs, edited, sets)
        ]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_SCHEMA)], schema=_SCHEMA)

    return ordered.select("k", "t", "r", "lent").mapInArrow(stream, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_with_next(table(spark, sf_dir, "documents"))
