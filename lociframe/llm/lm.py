"""Language-model scores by deleted interpolation of word n-grams.

The outcomes of a token are those of the base model: the words of the training texts, the end of a text, and one unknown
word for all others. Given the token before (or the start of the text), an outcome's probability is a mixture of the
bigram and the unigram maximum-likelihood estimates, a uniform one over known words, and all mass on the unknown word.
Contexts are put into buckets by how often they were seen, each with weights of its own. The weights are fitted by
expectation-maximisation on held-out counts: a part of the training texts is deleted from the counts (by a hash of its
own, within the training texts) and predicted from the rest; the model itself then counts all training texts. Each
estimate is a distribution, and so is the mixture. Texts that are not learnt from change nothing but their own scores.

Counts are not bounded and stay distributed. A task turns whole texts, a chunk at a time, into the chunk's distinct words
and word pairs, as hashes. These go to hash ranges to be counted, where a hot word is one entry for each chunk, and their
counts come back to the chunks, whose texts are scored whole: what is moved follows the number of words. A range stands
for BUCKET bytes of text on average, so memory follows CHUNK and BUCKET, not the input. Word keys have 64 bits, pair keys
56, so of 10 ** 12 distinct pairs some 10 ** -5 share a count.

Defined edge cases: a null or empty text has only its end token; rows with equal ids are texts of their own, each with
its row, null ids too; extra columns are ignored; without training rows, N and V are 0, every token is unknown and has
probability 1, in the base model too; without deleted rows the weights are DEFAULT.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import table, written
from .text import U64, Chunk, find_words, mix, raw_chunks, release

#: Upper bounds of the context counts of each bucket but the last.
CONTEXT_BUCKETS = (0, 1, 3, 10, 30, 100, 300, 1000, 10_000)
#: Weights of the bigram, the unigram, the uniform and the unknown-word estimate before they are fitted.
DEFAULT = (0.4, 0.3, 0.2, 0.1)
#: Bytes of text in a chunk; bytes of text that a hash range stands for.
CHUNK, BUCKET = 2 << 20, 16 << 20
#: Additive constant of the base model.
ALPHA = 0.1
#: Keys of the end and the start of a text: no word has them but by a chance of 2 ** -64.
END, START = U64(0xE0D5E0D5E0D5E0D5), U64(0x57A2757A2757A275)
#: Training rows that are learnt from and also deleted in turn; rows that are not learnt from.
DELETED, HELD = 1, 2


class Tokens:
    """The tokens of a chunk, its distinct words (start and end too) and word pairs, sorted by key."""

    def __init__(self, c: Chunk):
        n = c.hi - c.lo
        lengths = c.n_words + 1
        stop = np.cumsum(lengths)
        self.doc = np.repeat(np.arange(n), lengths)
        tokens = np.empty(int(stop[-1]), U64)
        ends = np.zeros(len(tokens), bool)
        ends[stop - 1] = True
        tokens[ends], tokens[~ends] = END, c.hashes
        before = np.empty(len(tokens), U64)
        before[1:] = tokens[:-1]
        before[stop - lengths] = START
        self.words, place = np.unique(np.concatenate((tokens, [START])), return_inverse=True)
        self.word = place[:-1]
        self.context = np.empty(len(tokens), np.int64)
        self.context[1:] = self.word[:-1]
        self.context[stop - lengths] = place[-1]
        self.pairs, self.first, self.pair = np.unique(mix(tokens * U64(0x9E3779B97F4A7C15) + mix(before)) >> U64(8), return_index=True, return_inverse=True)
        self.start = int(place[-1])

    def counts(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words and pairs in the texts marked in use."""
        mine = use[self.doc]
        words = np.bincount(self.word[mine], minlength=len(self.words))
        words[self.start] = use.sum()
        return words, np.bincount(self.pair[mine], minlength=len(self.pairs))


def packed(x: np.ndarray, width: int = 0) -> bytes:
    """Non-negative integers as bytes in planes (first all lowest bytes), as many planes as the largest one needs."""
    width = width or max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, pa.Array, Chunk]]:
    """(number, deleted, roles, keys, chunk without its words) of batches of t, role, key: deleted rows have chunks of their
    own. A number stands for the place and the content of a chunk, so another pass can't mistake it."""
    part, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        roles = batch.column(1).to_numpy(zero_copy_only=False)
        for deleted in (False, True):
            rows = np.flatnonzero((roles == DELETED) == deleted)
            for c in raw_chunks(batch.column(0).take(pa.array(rows)), CHUNK):
                mine = rows[c.lo : c.hi]
                number = mix(np.array([part, serial, zlib.crc32(c.data), zlib.crc32(c.offsets.tobytes())], np.int64).view(U64))
                number = mix(number * np.array([3, 5, 7, 11], U64)).sum(dtype=U64, keepdims=True)
                yield int(number.view(np.int64)[0]), deleted, roles[mine], batch.column(2).take(pa.array(mine)), c
                serial += 1


_SENT = "bucket int, chunk long, deleted boolean, words binary, n binary, pairs binary, m binary"
_BACK = "chunk long, bucket int, deleted boolean, n binary, m binary, rest_n binary, rest_m binary, stat string, value long"


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """Training counts of every chunk's words and pairs, in the order of their keys, by bucket: of all training rows, and
    for deleted chunks also without deleted rows; and, as rows without a chunk, N and V of both (written)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        cut = np.arange(buckets + 1, dtype=np.float64) / buckets
        bounds = [(cut[1:-1] * 2.0**bits).astype(U64) for bits in (64, 56)]
        for number, deleted, roles, _, c in _chunked(batches):
            t = Tokens(find_words(c))
            n, m = t.counts(roles != HELD)
            edges = [np.concatenate(([0], np.searchsorted(k, b), [len(k)])) for k, b in zip((t.words, t.pairs), bounds)]
            out = [(b, number, deleted, packed(t.words[s:e], 8), packed(n[s:e]), packed(t.pairs[u:v], 7), packed(m[u:v])) for b, (s, e, u, v) in enumerate(zip(edges[0][:-1].tolist(), edges[0][1:].tolist(), edges[1][:-1].tolist(), edges[1][1:].tolist())) if e > s or v > u]
            types = (pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), types)], names=[x.split()[0] for x in _SENT.split(", ")])
        release()

    def count(group: pa.Table) -> pa.Table:
        chunk, deleted = group.column("chunk").to_pylist(), np.array(group.column("deleted").to_pylist())
        stats: dict[str, int] = {}
        sides = []
        for keys, n in (("words", "n"), ("pairs", "m")):
            parts = [unpacked(x) for x in group.column(keys).to_pylist()]
            sizes = np.array([len(x) for x in parts])
            key, place = np.unique(np.concatenate(parts), return_inverse=True)
            times = np.concatenate([unpacked(x) for x in group.column(n).to_pylist()]).astype(np.int64)
            gone = np.repeat(deleted, sizes)
            total, rest = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            np.add.at(total, place, times)
            np.add.at(rest, place[~gone], times[~gone])
            if keys == "words":
                real = key != START
                stats = {"N": int(total[real].sum()), "V": int((total[real] > 0).sum()), "rest N": int(rest[real].sum()), "rest V": int((rest[real] > 0).sum())}
            ends = np.cumsum(sizes)
            sides.append([(packed(total[place[e - s : e]]), packed(rest[place[e - s : e]]) if d else None) for s, e, d in zip(sizes.tolist(), ends.tolist(), deleted.tolist())])
        bucket = group.column("bucket")[0].as_py()
        rows = [(c, bucket, d, n, m, rn, rm, None, None) for c, d, (n, rn), (m, rm) in zip(chunk, deleted.tolist(), *sides)]
        rows += [(None, bucket, None, None, None, None, None, k, v) for k, v in stats.items()]
        types = (pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 4, pa.string(), pa.int64())
        return pa.table({x.split()[0]: pa.array(v, y) for x, v, y in zip(_BACK.split(", "), zip(*rows), types)})

    return written(docs.mapInArrow(deal, _SENT).groupBy("bucket").applyInArrow(count, _BACK), "lm-counts")


_TEXTS = "chunk long, keys array<bigint>, roles binary, data binary, offsets binary"


def _with_counts(docs: DataFrame, counts: DataFrame, n: str, m: str, parts: int, only_deleted: bool = False) -> DataFrame:
    """_TEXTS of docs with the counts n and m of their chunks, range by range."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for number, deleted, roles, keys, c in _chunked(batches):
            if only_deleted and not deleted:
                continue
            columns = [pa.array([number]), pa.array([keys.to_pylist()], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in (roles.astype(np.int8), c.data, c.offsets)]]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _TEXTS.split(", ")])
        release()

    sent = docs.mapInArrow(send, _TEXTS).repartition(parts, "chunk")
    back = counts.select("chunk", F.struct("bucket", F.col(n).alias("n"), F.col(m).alias("m")).alias("c")).repartition(parts, "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return sent.join(back, "chunk", "left").select("keys", "roles", "data", "offsets", F.col("c.n").alias("n"), F.col("c.m").alias("m"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, Tokens, np.ndarray, np.ndarray]]:
    """(keys, roles, tokens, word counts, pair counts) of each chunk of _with_counts."""
    np.seterr(over="ignore")
    for batch in batches:
        for i in range(batch.num_rows):
            keys, roles, data, offsets, n, m = (x[i].as_py() for x in batch.columns)
            if n is None:
                raise RuntimeError("texts came in another order than when they were counted; write the table first")
            offsets = np.frombuffer(offsets, np.int64)
            t = Tokens(find_words(Chunk(0, len(offsets) - 1, np.frombuffer(data, np.uint8), offsets)))
            yield keys, np.frombuffer(roles, np.int8), t, *[np.concatenate([unpacked(x) for x in parts]).astype(np.float64) for parts in (n, m)]
        release()


#: Cells of log10 of an estimate over the uniform one, in which predictions of deleted rows are counted; cell 0: not seen.
CELLS, CELL, LOWEST = 400, 0.05, -10.0


def _cell(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.clip(np.round((np.log10(ratio) - LOWEST) / CELL), 0, CELLS - 2)
    return np.where(ratio > 0, 1 + np.nan_to_num(x, neginf=0), 0).astype(np.int64)


def estimates(t: Tokens, n: np.ndarray, m: np.ndarray, total: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct pair: the bigram, unigram, uniform and unknown-word estimate, and the bucket of its context; and the
    counts of its second word."""
    context, word = n[t.context[t.first]], n[t.word[t.first]]
    p = np.zeros((len(m), 4))
    np.divide(m, context, out=p[:, 0], where=context > 0)
    p[:, 1] = word / max(total, 1)
    p[:, 2] = (word > 0) / max(vocabulary, 1)
    p[:, 3] = word == 0
    return p, np.searchsorted(CONTEXT_BUCKETS, context, side="left"), word


def interpolation_weights(hist: dict[tuple[int, int, int], int], steps: int = 100) -> np.ndarray:
    """Weights by context bucket and estimate, by expectation-maximisation; hist: tokens by bucket and cells of the bigram
    and the unigram over the uniform estimate, (bucket, -1, -1) those of unknown words."""
    out = np.tile(np.array(DEFAULT), (len(CONTEXT_BUCKETS) + 1, 1))
    value = lambda cell: np.where(cell > 0, 10.0 ** (LOWEST + (cell - 1) * CELL), 0.0)
    for b in range(len(out)):
        rows = np.array([(x, y, k) for (a, x, y), k in hist.items() if a == b and x >= 0], float).reshape(-1, 3)
        unknown = hist.get((b, -1, -1), 0)
        seen = rows[:, 2].sum()
        if seen + unknown:
            rate = (unknown + 0.5) / (seen + unknown + 1)
            w = np.full(3, 1 / 3)
            p = np.stack((value(rows[:, 0]), value(rows[:, 1]), np.ones(len(rows))), 1)
            for _ in range(steps if seen else 0):
                r = p * w
                r *= (rows[:, 2] / r.sum(1))[:, None]
                w = (r.sum(0) + 0.01) / (seen + 0.03)
            out[b] = np.concatenate((w * (1 - rate), [rate]))
    out[0, 0] = 0.0  # a context that was never seen has no bigram estimate
    return out / out.sum(1, keepdims=True)


def _deleted_predictions(docs: DataFrame, counts: DataFrame, total: int, vocabulary: int, parts: int) -> dict[tuple[int, int, int], int]:
    """Tokens of deleted rows by bucket and cells, predicted from the other training rows; (buckets * CELLS ** 2) at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, t, n, m in _rows(batches):
            p, bucket, word = estimates(t, n, m, total, vocabulary)
            times = np.bincount(t.pair, minlength=len(m))
            known = word > 0
            code = np.where(known, (bucket * CELLS + _cell(p[:, 0] * vocabulary)) * CELLS + _cell(p[:, 1] * vocabulary), -1 - bucket)
            key, place = np.unique(code, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(place, weights=times).astype(np.int64))], names=["code", "n"])

    rows = _with_counts(docs, counts.filter("deleted"), "rest_n", "rest_m", parts, True)
    got = rows.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {((c // CELLS // CELLS, c // CELLS % CELLS, c % CELLS) if c >= 0 else (-1 - c, -1, -1)): r for c, r in got}


def score_texts(df: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; held: rows not learnt from.

    The table is read several times and must come in the same order each time, as files do (else it raises).
    """
    deleted = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("deleted")), F.lit(10)) == 0
    role = F.when(F.coalesce(held, F.lit(False)), HELD).when(deleted, DELETED).otherwise(0)
    docs = df.select(F.col(text).cast("string").alias("t"), role.cast("int").alias("role"), F.col(key).cast("bigint").alias("key"))
    size = docs.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    buckets, parts = max(64, size // BUCKET), max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    counts = _counted(docs, buckets)
    stats = {r["stat"]: r["n"] for r in counts.filter("chunk is null").groupBy("stat").agg(F.sum("value").alias("n")).collect()}
    total, vocabulary = stats.get("N", 0), stats.get("V", 0)
    counts = counts.filter("chunk is not null")
    weights = interpolation_weights(_deleted_predictions(docs, counts, stats.get("rest N", 0), stats.get("rest V", 0), parts))
    if not total:
        weights = np.tile([0.0, 0.0, 0.0, 1.0], (len(weights), 1))
    scale = np.log10(total + ALPHA * (vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, roles, t, n, m in _rows(batches):
            p, bucket, word = estimates(t, n, m, total, vocabulary)
            score = np.log10((p * weights[bucket]).sum(1))
            base = np.log10(word + ALPHA) - scale
            tokens, known, base, score = (np.bincount(t.doc, weights=x[t.pair], minlength=len(keys)) for x in (np.ones(len(m)), word > 0, base, score))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(roles == HELD), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["key", "held", "tokens", "known", "base", "score"])

    out = _with_counts(docs, counts, "n", "m", parts).mapInArrow(run, "key long, held boolean, tokens long, known long, base double, score double")
    return out.select(
        F.col("key").alias(key), F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_texts(table(spark, sf_dir, "documents"), held)
