"""Quality of documents from random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Every word has an index vector, a few +1 and -1 among DIM places that its hash names, and falls into one of CELLS cells. A
cell's vector is the sum of the index vectors of the words at most WINDOW places from its own, over all texts: whole-number
sums, alike on any partitioning, in a table whose size is fixed whatever the corpus. Cell vectors are centred and scaled to
length one; a document is pooled to the mean and the spread of its words' vectors, with its length and share of distinct
words. A network of one hidden layer is fitted in numpy to labelled documents, and the temperature of its probabilities to
labelled documents it was not fitted to.

Words are runs of letters, of digits or of other signs, as written: upper case and signs are what tells junk.

Bounds that are parameters: CELLS x DIM numbers of the table, SAMPLE labelled rows for the network (of least hash); words
are counted over all texts.

Defined edge cases: a null or empty text has no words and the score of zero features; with labels of one kind only, or none,
every score is their share (one half if there are none); of rows that repeat a labelled id the least text counts, of labels
that repeat an id the least; rows with a null key are scored and never learnt from; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import table, written
from .text import U64, Chunk, mix, raw_chunks, span_hashes

CELLS, DIM, SPARSE, WINDOW = 1 << 14, 64, 4, 2
#: Cells that move as one row; first summed in so many parts each.
BLOCK, PARTS = 256, 16
#: Words whose vectors are gathered at a time.
GATHER = 1 << 16
#: Labelled rows used for training, at most; hidden units; steps and decay of the fit.
SAMPLE, HIDDEN, STEPS, DECAY = 12_000, 24, 400, 1e-3
#: Score from which a document counts as good.
GOOD = 0.3

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letters, 2 digits, 3 other signs
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2


def find_runs(c: Chunk) -> Chunk:
    """Fills in the runs of one kind as the words of a chunk."""
    c.low = c.data
    kind = _KIND[c.data]
    n = len(kind)
    edge = np.zeros(n + 1, bool)
    edge[c.offsets] = True
    differs = np.concatenate(([True], kind[1:] != kind[:-1])) if n else np.zeros(0, bool)
    begins = np.flatnonzero((differs | edge[:-1]) & (kind > 0))
    differs = np.concatenate((kind[1:] != kind[:-1], [True])) if n else np.zeros(0, bool)
    c.starts, c.ends = begins, np.flatnonzero((differs | edge[1:]) & (kind > 0)) + 1
    c.words = np.searchsorted(c.starts, c.offsets)
    c.hashes = span_hashes(c, c.starts, c.ends) if n else np.zeros(0, U64)
    return c


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> U64(50)).astype(np.int64) % CELLS


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors of words, SPARSE of each."""
    x = mix(h ^ U64(0x2545F4914F6CDD1D))
    at = [(x >> U64(12 * i)).astype(np.int64) & 2047 for i in range(SPARSE)]
    return np.stack([a % DIM for a in at], 1), np.stack([(a >> 10) * 2 - 1 for a in at], 1)


def add_contexts(c: Chunk, into: np.ndarray) -> None:
    """Adds the index vectors of each word, and of those near it in its text, to the word's cell (into: CELLS * DIM)."""
    doc = np.repeat(np.arange(c.hi - c.lo), c.n_words)
    cell = _cell(c.hashes) * DIM
    for lo in range(0, len(cell), GATHER):
        hi = min(lo + GATHER, len(cell))
        from_, to = max(lo - WINDOW, 0), min(hi + WINDOW, len(cell))
        place, sign = index_vectors(c.hashes[from_:to])
        for step in range(-WINDOW, WINDOW + 1):
            i = np.arange(max(lo, -step), min(hi, len(cell) - step))
            i = i[doc[i] == doc[i + step]]
            j = i + step - from_
            into += np.bincount((cell[i, None] + place[j]).ravel(), weights=sign[j].ravel(), minlength=CELLS * DIM).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=BLOCK * DIM * 8, codec="zstd", asbytes=True), np.int64)


_SUMS = "part int, block int, v binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows (part, block, v) of a task, taken in one by one."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, block, v in zip(*(x.to_pylist() for x in batch.columns)):
            held[part, block] = held.get((part, block), 0) + _unpacked(v)
    for (part, block), v in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([_packed(v)], pa.binary())], names=["part", "block", "v"])


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """Vectors of length one (or zero) of all cells, from all texts. The driver gets CELLS * DIM numbers at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        total = np.zeros(CELLS * DIM, np.int64)
        for batch in batches:
            for c in raw_chunks(batch.column(0)):
                add_contexts(find_runs(c), total)
        for i, v in enumerate(total.reshape(-1, BLOCK * DIM)):
            if v.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_packed(v)], pa.binary())], names=["block", "v"])

    parts = df.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "block int, v binary")
    parts = parts.select((F.spark_partition_id() % PARTS).alias("part"), "block", "v")
    sums = parts.repartition("part", "block").mapInArrow(_summed, _SUMS).withColumn("part", F.lit(0))
    out = np.zeros((CELLS // BLOCK, BLOCK * DIM))
    for r in sums.repartition("block").mapInArrow(_summed, _SUMS).collect():
        out[r["block"]] = _unpacked(r["v"])
    out = out.reshape(CELLS, DIM)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
    if size.any():
        out[size[:, 0] > 0] -= out[size[:, 0] > 0].mean(0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
    return out.astype(np.float32)


#: Features of a document: mean and spread of its words' vectors, length, share of distinct words, whether it has words.
FEATURES = 2 * DIM + 3


def pooled(c: Chunk, vectors: np.ndarray) -> np.ndarray:
    """Features of each text of a chunk."""
    n = c.hi - c.lo
    out = np.zeros((n, FEATURES))
    total = np.zeros((n, 2 * DIM))
    doc = np.repeat(np.arange(n), c.n_words)
    cell = _cell(c.hashes)
    for lo in range(0, len(cell), GATHER):
        own = doc[lo : lo + GATHER]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        x = vectors[cell[lo : lo + GATHER]].astype(float)
        total[own[first], :DIM] += np.add.reduceat(x, first)
        total[own[first], DIM:] += np.add.reduceat(x * x, first)
    words = np.maximum(c.n_words, 1)[:, None]
    mean = total[:, :DIM] / words
    out[:, :DIM] = mean
    out[:, DIM : 2 * DIM] = np.sqrt(np.maximum(total[:, DIM:] / words - mean**2, 0))
    out[:, -3] = np.log1p(c.n_words)
    if len(doc):
        _, one = np.unique(mix(doc.astype(U64) + U64(1)) ^ c.hashes, return_index=True)
        out[:, -2] = np.bincount(doc[one], minlength=n) / words[:, 0]
    out[:, -1] = c.n_words > 0
    return out


@dataclass
class Network:
    """Standardised features, one hidden layer (tanh), a logit divided by the temperature; or, unfitted, one score."""

    share: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    hidden: np.ndarray | None = None  # (features + 1) x HIDDEN
    out: np.ndarray | None = None  # HIDDEN + 1
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.centre) / self.scale
        h = np.tanh(x @ self.hidden[:-1] + self.hidden[-1])
        return h @ self.out[:-1] + self.out[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.hidden is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, apart: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, rate: float = 0.02, decay: float = DECAY, seed: int = 13) -> Network:
    """A network fitted by Adam steps to the rows not set apart, its temperature to those set apart: the least loss over
    powers of two to a twentieth, with targets as if one more row of the other label had been seen."""
    share = (float(y.sum()) + 1) / (len(y) + 2)
    fit = ~apart
    if len(np.unique(y[fit])) < 2:
        return Network(share)
    draw = np.random.default_rng(seed)
    net = Network(share, x[fit].mean(0), np.maximum(x[fit].std(0), 1e-6))
    z = (x[fit] - net.centre) / net.scale
    z = np.concatenate((z, np.ones((len(z), 1))), 1)
    want = y[fit].astype(float)
    w, v = draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), draw.normal(0, 1 / np.sqrt(hidden), hidden + 1)
    v[-1] = np.log(want.mean() / (1 - want.mean()))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    for t in range(1, steps + 1):
        h = np.tanh(z @ w)
        p = 1 / (1 + np.exp(-np.clip(h @ v[:-1] + v[-1], -500, 500)))
        g = (p - want) / len(want)
        gv = np.append(h.T @ g, g.sum()) + decay * np.append(v[:-1], 0)
        gw = z.T @ (np.outer(g, v[:-1]) * (1 - h * h)) + decay * w
        for a, grad, i in ((w, gw, 0), (v, gv, 2)):
            moments[i] = 0.9 * moments[i] + 0.1 * grad
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * grad * grad
            a -= rate * (moments[i] / (1 - 0.9**t)) / (np.sqrt(moments[i + 1] / (1 - 0.99**t)) + 1e-8)
    net.hidden, net.out = w, v
    if apart.any() and len(np.unique(y[apart])) == 2:
        logits, one = net.logits(x[apart]), y[apart] == 1
        wanted = np.where(one, (one.sum() + 1) / (one.sum() + 2), 1 / ((~one).sum() + 2))
        tried = 2.0 ** np.linspace(-3, 6, 181)
        net.temperature = float(tried[np.argmin([_loss(logits / t, wanted) for t in tried])])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def _featured(df: DataFrame, keep: list[str], vectors: np.ndarray) -> DataFrame:
    """keep and the features of column t (doubles as binary) of each row."""
    slim = df.select(*keep, "t")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1]) + ", x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for c in raw_chunks(batch.column(len(keep))):
                x = pa.array([r.tobytes() for r in pooled(find_runs(c), vectors)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.slice(c.lo, c.hi - c.lo) for b in batch.columns[:-1]), x], names=[*keep, "x"])

    return slim.mapInArrow(run, schema)


def fold(key: str, folds: int) -> Column:
    """Remainder of the crc32 of a key as text."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Word vectors of all documents, and a network from the labels given (0 or 1 by key): at most `sample` ids, those of
    least hash, one in five of which is set apart for the temperature."""
    vectors = word_vectors(documents, text)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter("key is not null and y is not null").groupBy("key").agg(F.min("y").alias("y"))
    few = written(known.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(sample), "wordvec-labels")
    texts = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).join(F.broadcast(few), "key").groupBy("key", "y").agg(F.min("t").alias("t"))
    rows = _featured(texts.withColumn("apart", F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(3)), F.lit(5)) == 0), ["y", "apart"], vectors).collect()
    rows.sort(key=lambda r: (r["apart"], r["y"], r["x"]))
    if not rows:
        return QualityModel(vectors, Network(0.5))
    x = np.stack([np.frombuffer(r["x"]) for r in rows])
    return QualityModel(vectors, fit_network(x, np.array([r["y"] for r in rows]), np.array([r["apart"] for r in rows], bool)))


def quality_scores(df: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (how likely the document is good) of every row."""
    slim = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for c in raw_chunks(batch.column(1)):
                score = model.network.scores(pooled(find_runs(c), model.vectors))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(score)], names=["key", "score"])

    return slim.mapInArrow(run, f"key {slim.schema[0].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    out = quality_scores(documents, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
