"""Mixing a corpus to target token weights by domain, with soft domain membership.

A classifier trained on all rows of a labelled table gives each document a posterior over domains; its tokens count towards every
domain by that share. Nonnegative rates (0 to 1: how likely a document is kept) are then fitted so that the expected
tokens of the domains meet targets given as weights of the mixture: least squares of the gaps (squared, over the tokens the
domain has) by projected gradient, from all rates at 1, with momentum that starts anew where it would lead away.

A step takes from a document's rate the gaps' relative sizes weighted by its posterior, so steps are of length one at any
size of the corpus and whatever the lengths of documents: the matrix of the steps has eigenvalues from 0 to 1. Each is one
distributed sum over the written table of posteriors. A document's rate is replayed from the steps' gaps, a few numbers
each, so nothing is kept per document and the same rates come from the texts again.

Defined edge cases: a null or empty text has one token (its end) and the posterior of a text without features;
repeated rows are documents of their own; domains without labelled rows get no share, and with fewer than two domains
every rate is 1; a domain of the model must have a weight (0 drops it); an empty table gives an empty result; extra columns
are ignored by the fit and kept by `thinned`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ids import split_rows
from .tables import discard, fresh, table, written
from .text import U64, chunks, mix

#: Steps of the rates, at most.
STEPS = 150
#: Target weights of the query's mixture: good text by language, and text of low quality.
WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.1, "low": 0.05}
#: Tokens of a mixture, as a share of what its scarcest domain allows: with soft membership its documents are others' too.
FILL = 0.9
#: Target weights of the pipeline's mixture, in which all good text stays.
QUALITY_WEIGHTS = {"good": 0.95, "low": 0.05}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(x) for x in "#*$%&|<>"]] = True


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # (dense + 1) x domains

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate((np.ones((len(x), 1)), x), 1) @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


#: Features of a text: shares and scales (see described()), then hashed words in CELLS cells.
DENSE, CELLS = 9, 256
N_FEATURES = DENSE + CELLS


def described(c) -> np.ndarray:
    """Features of each text of a chunk: shares and scales (symbols, digits, repeated words and lines, lengths), and roots of
    the shares of its words by the hash of the word."""
    n = c.hi - c.lo
    out = np.zeros((n, N_FEATURES))
    size = np.maximum(np.diff(c.offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return np.diff(total[c.offsets]) / size

    d = c.data
    out[:, 0] = np.minimum(share(_SYMBOLS[d]) * 10, 3)
    out[:, 1] = np.minimum(share((d >= 48) & (d <= 57)) * 10, 3)
    out[:, 2] = np.minimum(share((d == 46) | (d == 44)) * 20, 3)
    out[:, 3] = np.minimum(share(d == 10) * 50, 3)
    words = np.maximum(c.n_words, 1)
    out[:, 4] = np.log1p(c.n_words) / 5
    doc = np.repeat(np.arange(n), c.n_words)
    if len(doc):
        pair = mix(doc.astype(U64) + U64(1)) ^ c.hashes
        _, one = np.unique(pair, return_index=True)
        out[:, 5] = np.bincount(doc[one], minlength=n) / words
        three = np.zeros(n)
        if len(doc) > 2:
            same = doc[2:] == doc[:-2]
            g = mix(c.hashes[2:] * U64(3) + mix(c.hashes[1:-1] * U64(5) + mix(c.hashes[:-2])))[same] ^ mix(doc[2:][same].astype(U64) + U64(7))
            _, first = np.unique(g, return_index=True)
            total = np.bincount(doc[2:][same], minlength=n)
            three = 1 - np.bincount(doc[2:][same][first], minlength=n) / np.maximum(total, 1)
            three[total == 0] = 0
        out[:, 6] = three * 3
        out[:, 7] = np.minimum(np.bincount(doc, weights=c.ends - c.starts, minlength=n) / words / 10, 3)
    out[:, 8] = c.n_words < 50
    cells = np.bincount(doc * CELLS + (c.hashes >> U64(40)).astype(np.int64) % CELLS, minlength=n * CELLS).reshape(n, CELLS)
    out[:, DENSE:] = np.sqrt(cells / words[:, None])
    return out


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum over rows (y, x: class and features) of what part(x, y) gives for a batch: `size` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, -1)
                out += part(np.concatenate((np.ones((len(x), 1)), x), 1), batch.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], names=["i", "s"])

    out = np.zeros(size)
    for r in rows.select("y", "x").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"]
    return out


def fit_softmax(rows: DataFrame, n: int, k: int, width: int, ridge: float = 1e-3, steps: int = 200, tolerance: float = 1e-3) -> np.ndarray:
    """Multinomial logistic regression of y (0 to k - 1) on x (`width` 32-bit floats) of n rows; the intercept comes first.

    Each step is one distributed sum of the gradient; it is divided by a bound of the second derivatives that one pass adds up, so
    no step overshoots, with momentum that starts anew where it leads away. Ends when the gradient is within the tolerance."""
    m = width + 1
    bound = _summed(rows, lambda x, y: (x.T @ x).ravel(), m * m).reshape(m, m) / (2 * n) + ridge * np.eye(m)
    w = ahead = np.zeros((m, k))
    speed = 1.0

    def slope(at: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = x @ at
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            return (x.T @ (np.eye(k)[y] - p)).ravel()

        return _summed(rows, part, m * k).reshape(m, k) / n - ridge * at

    for _ in range(steps):
        g = slope(ahead)
        now = ahead + np.linalg.solve(bound, g)
        if np.abs(g).max() < tolerance:
            return now
        if (g * (now - w)).sum() < 0:
            speed = 1.0
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        w, ahead, speed = now, now + (speed - 1) / faster * (now - w), faster
    return w


def _featured(df: DataFrame, keep: list[str], text: str, model: DomainModel | None) -> DataFrame:
    """keep, tokens and the posterior (or, without a model, the features as 32-bit floats) of each row."""
    slim = df.select(*keep, F.col(text).cast("string").alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1]) + ", n_tokens long, x " + ("array<double>" if model else "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for c in chunks(batch.column(len(keep))):
                x = described(c)
                x = pa.array(model.posterior(x).tolist(), pa.list_(pa.float64())) if model else pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
                columns = [b.slice(c.lo, c.hi - c.lo) for b in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(c.n_words + 1), x], names=[*keep, "n_tokens", "x"])

    return slim.mapInArrow(run, schema)


def train(documents: DataFrame, labels: DataFrame, domain: Column, key: str = "doc_id", text: str = "text") -> DomainModel | None:
    """A domain classifier from all labelled rows (key and what `domain` is made of); of rows that repeat an id, the least text
    and domain. A bitmap keeps most other texts out of the join."""
    marked = labels.select(key, domain.alias("d")).filter(F.col("d").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("d").alias("d"))
    name = lambda df: F.xxhash64(df[key].cast("string"))
    slim = documents.select(key, F.col(text).cast("string").alias("t"))
    near = split_rows(slim.withColumn("_h", name(slim)), marked.select(name(marked).alias("_h")), "_h")[1]
    texts = near.join(marked, key).groupBy(key, "d").agg(F.min("t").alias("t"))
    rows = written(_featured(texts, ["d"], "t", None), "features")
    sizes = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    model = None
    if len(names) > 1:
        y = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("d")) - 1
        model = DomainModel(names, fit_softmax(rows.select(y.alias("y"), "x"), sum(sizes.values()), len(names), N_FEATURES))
    discard(rows)
    return model


Step = tuple[np.ndarray, float]


def rates_from(p: np.ndarray, steps: list[Step]) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents (p: posteriors) after the steps (relative gaps, momentum), and where the next step starts from."""
    r = ahead = np.ones(len(p))
    for gap, momentum in steps:
        now = np.clip(ahead - p @ gap, 0, 1)
        r, ahead = now, now + momentum * (now - r)
    return r, ahead


def fit_rates(shares: DataFrame, targets: np.ndarray, max_steps: int = STEPS, tolerance: float = 1e-3) -> list[Step]:
    """Steps of the rates (see rates_from) for shares (p: posteriors, n: tokens); targets: wanted tokens of each domain.

    Ends when all totals are within the tolerance of their targets, or, where rates from 0 to 1 can't meet them, when two
    steps change no total by more than a tenth of it. Raises if steps run out before.
    """
    k = len(targets)

    def totals(steps: list[Step]) -> np.ndarray:
        """Expected tokens by domain: of all documents, at the rates, and where the next step starts from."""

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((3, k))
            for batch in batches:
                p = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                n = batch.column(1).to_numpy(zero_copy_only=False)
                r, ahead = rates_from(p, steps)
                out += np.stack((n, n * r, n * ahead)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

        got = shares.select("p", "n").mapInArrow(total, "s array<double>").select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(3 * k)
        for r in got:
            out[r["i"]] = r["s"]
        return out.reshape(3, k)

    steps: list[Step] = []
    speed, before, still = 1.0, None, 0
    for _ in range(max_steps):
        every, now, ahead = totals(steps)
        size = np.maximum(every, 1.0)
        gap = (now - targets) / size
        cost = float((gap * gap * size).sum())
        if before is not None:
            still = still + 1 if (np.abs(now - before[0]) <= 0.1 * tolerance * size).all() else 0
            if cost > before[1]:
                # Momentum leads away: the next step starts from the rates themselves.
                speed = 1.0
                steps[-1] = (steps[-1][0], 0.0)
                ahead = now
        if (np.abs(now - targets) <= tolerance * np.maximum(targets, 1e-3 * size)).all() or still == 2:
            return steps
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        steps.append(((ahead - targets) / size, (speed - 1) / faster))
        speed, before = faster, (now, cost)
    raise RuntimeError(f"rates not fitted in {max_steps} steps: gaps {gap.tolist()} of domains with {every.tolist()} tokens")


def targets_of(now: np.ndarray, domains: list[str], weights: dict[str, float], whole: str | None = None, fill: float = FILL) -> np.ndarray:
    """Wanted tokens of each domain (which has `now`) for a mixture of the given weights: `fill` times as many as the scarcest
    domain allows; with `whole`, as many as go with all of that domain, where what others lack is not made up."""
    if missing := [d for d in domains if d not in weights]:
        raise ValueError(f"domains without a target weight: {missing}")
    w = np.array([weights[d] for d in domains], float)
    if (w < 0).any() or not w.sum() > 0:
        raise ValueError("target weights must be nonnegative, and one positive")
    if whole is not None and whole in domains and weights[whole] > 0:
        at = domains.index(whole)
        return np.minimum(w * now[at] / w[at], now)
    used = (w > 0) & (now > 0)
    return w * fill * (now[used] / w[used]).min() * (now > 0) if used.any() else np.zeros(len(w))


def weights_in(table: DataFrame) -> dict[str, float]:
    """Weights from a table (domain, weight) with a row for each domain."""
    return {r["domain"]: float(r["weight"]) for r in table.select("domain", "weight").collect()}


def _prepared(df: DataFrame, model: DomainModel, weights: dict[str, float], whole: str | None, key: str, text: str) -> tuple[DataFrame, list[Step]]:
    """Posteriors of all rows, written once, and the fitted steps."""
    rows = written(_featured(df.select(F.col(key).alias("key"), F.col(text).alias("text")), ["key"], "text", model), "posteriors")
    shares = rows.select(F.col("x").alias("p"), F.col("n_tokens").cast("double").alias("n"))
    now = shares.agg(*[F.sum(F.col("p")[i] * F.col("n")).alias(f"s{i}") for i in range(len(model.domains))]).first()
    return rows, fit_rates(shares, targets_of(np.array([x or 0.0 for x in now]), model.domains, weights, whole))


def _unit(key: str) -> Column:
    """A number from 0 to 1 for each key."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mixed(df: DataFrame, model: DomainModel | None, weights: dict[str, float], whole: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, posterior by domain (p_<domain>), rate and kept of every row.

    weights: of the domains in the mixture (see targets_of). A row is kept if the number that the hash of its key gives, from
    0 to 1, lies below its rate.
    """
    if model is None:
        return _featured(df, [key], text, None).select(key, "n_tokens", F.lit(1.0).alias("rate"), F.lit(True).alias("kept"))
    rows, steps = _prepared(df, model, weights, whole, key, text)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(model.domains))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates_from(p, steps)[0])], names=["key", "n_tokens", "x", "rate"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", rate double"
    out = rows.mapInArrow(rate, schema)
    return out.select(F.col("key").alias(key), "n_tokens", *[F.col("x")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", (_unit("key") < F.col("rate")).alias("kept"))


def thinned(df: DataFrame, model: DomainModel | None, weights: dict[str, float], whole: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that `mixed` keeps, with all their columns; rates are found again from the text, without a join."""
    if model is None:
        return df
    _, steps = _prepared(df, model, weights, whole, key, text)
    marked = df.withColumn(fresh(df, "_text"), F.col(text).cast("string"))
    marked = marked.withColumn(fresh(marked, "_unit"), F.coalesce(_unit(key), F.lit(0.0)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            rates = [np.zeros(0)]
            for c in chunks(batch.column(batch.num_columns - 2)):
                rates.append(rates_from(model.posterior(described(c)), steps)[0])
            mask = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) < np.concatenate(rates)
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], schema=pa.schema(list(batch.schema)[:-2])).filter(pa.array(mask))

    return marked.mapInArrow(keep, df.schema)


def quality_domain() -> Column:
    return F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")


def language_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labelled documents: low where quality is 0, the language of the others."""
    known = labels.filter("quality is not null").select("doc_id", "quality").join(documents.select("doc_id", "lang"), "doc_id")
    return known.select("doc_id", F.when(F.col("quality") == 0, "low").otherwise(F.col("lang")).alias("domain"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, language_labels(documents, table(spark, sf_dir, "labels")), F.col("domain"))
    return mixed(documents, model, WEIGHTS)
