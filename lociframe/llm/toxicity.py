"""Toxicity scores of text restored by a noisy-channel decoder.

Words that look disguised (digits or symbols in place of letters, letters drawn out, single letters spaced or dotted
apart) become lattices of the characters they may stand for; a Viterbi pass under a character trigram model picks the
likeliest reading, of any length. Letters apart are also read with word ends (the model's `$`, and wide gaps) in them. Any other word has one path through its lattice and is its own reading. A document is then scored
by the evidence of its restored words: log odds of words and word beginnings learnt from labelled rows, and a
logistic calibration of the strongest ones.

Trained on all labelled rows: Spark sums their counts, and the sums of each step of the calibration, so the driver holds the
words that count as evidence, at most 27 ** 3 letter trigrams and one row a step. Every document is scored whole. Only the
text is an input of the score.

Defined edge cases: a null or empty text gets the score of a text without evidence; labels that are null are left out
and repeated labels of one id count once (the higher one); without labelled rows of both kinds every score is the
share of toxic rows (0 without any); extra columns are ignored; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .ids import split_rows
from .tables import discard, fresh, table, written
from .text import Chunk, chunks, mix, span_hashes

#: A feature must occur in this many toxic rows, with this log odds.
MIN_ROWS, MIN_ODDS = 4, 2.0
THRESHOLD = 0.7
#: Byte lengths of word beginnings.
PREFIXES = (4, 5, 6, 7)

#: What a character may stand for in disguised words.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
SEPARATORS = ".-_*"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Log costs of the channel: reading a symbol as a letter, dropping a repeated letter, dropping a separator.
READ, DROP, JOIN = -1.0, -0.5, -0.2

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(x) for x in [*STANDS_FOR, *SEPARATORS]]] = True
#: Symbols that end a word in place of a letter (full stops and dashes end words as what they are).
_IS_LAST = np.zeros(256, bool)
_IS_LAST[[ord(x) for x in STANDS_FOR if not x.isdigit()]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True


@dataclass
class CharModel:
    """Character trigram model with bigram and unigram back-off; `^` stands before a word, `$` ends it."""

    counts: dict[str, int]
    memo: dict[str, str] = field(default_factory=dict)
    memo_words: dict[str, str] = field(default_factory=dict)
    logs: dict[str, float] = field(default_factory=dict)  # of three letters each, so of bounded size

    def __post_init__(self):
        self.context: dict[str, int] = {}
        self.pairs: dict[str, int] = {}
        self.firsts: dict[str, int] = {}
        self.singles: dict[str, int] = {}
        for g, n in self.counts.items():
            self.context[g[:2]] = self.context.get(g[:2], 0) + n
            self.pairs[g[1:]] = self.pairs.get(g[1:], 0) + n
            self.firsts[g[1]] = self.firsts.get(g[1], 0) + n
            self.singles[g[2]] = self.singles.get(g[2], 0) + n
        self.total = sum(self.counts.values())

    def log(self, a: str, b: str, c: str) -> float:
        got = self.logs.get(a + b + c)
        if got is None:
            got = self.logs[a + b + c] = self._log(a, b, c)
        return got

    def _log(self, a: str, b: str, c: str) -> float:
        p1 = (self.singles.get(c, 0) + 1) / (self.total + len(LETTERS) + 1)
        p2 = (self.pairs.get(b + c, 0) + 4 * p1) / (self.firsts.get(b, 0) + 4)
        p3 = (self.counts.get(a + b + c, 0) + 4 * p2) / (self.context.get(a + b, 0) + 4)
        return float(np.log(p3))

    def restore(self, word: str) -> str:
        """The likeliest reading of a lower-cased word."""
        return self._remembered(word, self.memo, False)

    def restore_words(self, word: str) -> list[str]:
        """The words of the likeliest reading that may end words anywhere."""
        return self._remembered(word, self.memo_words, True).split()

    def _remembered(self, word: str, memo: dict[str, str], ends: bool) -> str:
        got = memo.get(word)
        if got is None:
            got = self._decode(word, ends)
            if len(word) <= 40:  # longer ones hardly come again
                if len(memo) > 200_000:
                    memo.clear()
                memo[word] = got
        return got

    def _decode(self, word: str, ends: bool = False) -> str:
        best: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}  # a reading is its last letter and the reading before
        apart = all(len(x) <= 1 for x in _split(word))
        for i, ch in enumerate(word):
            options: list[tuple[str, float]] = []
            if ch in LETTERS:
                options.append((ch, 0.0))
                if i and word[i - 1] == ch:
                    options.append(("", DROP if i > 1 and word[i - 2] == ch else DROP * 8))
            elif ch in SEPARATORS and apart:
                options.append(("", JOIN))
            elif ch in STANDS_FOR:
                options += [(x, READ) for x in STANDS_FOR[ch]]
            else:
                options.append((ch, 0.0))
            step: dict[str, tuple[float, tuple]] = {}
            for state, (score, text) in best.items():
                for out, cost in options:
                    if out and out in LETTERS:
                        value, key = score + cost + self.log(state[0], state[1], out), state[1] + out
                    elif out:
                        value, key = score + cost - 4.0, "^^"
                    else:
                        value, key = score + cost, state
                    if key not in step or value > step[key][0]:
                        step[key] = (value, (out, text) if out else text)
            if ends:
                for state, (score, text) in list(step.items()):
                    value = score + self.log(state[0], state[1], "$")
                    if state != "^^" and ("^^" not in step or value > step["^^"][0]):
                        step["^^"] = (value, (" ", text))
            best = step
        last = [(score if ends and s == "^^" else score + self.log(s[0], s[1], "$"), text) for s, (score, text) in best.items()]
        text, out = max(last, key=lambda x: x[0])[1], []
        while text:
            out.append(text[0])
            text = text[1]
        return "".join(reversed(out))


def _split(word: str) -> list[str]:
    for s in SEPARATORS:
        word = word.replace(s, " ")
    return word.split(" ")


def cores(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last letter of each word that has one, and the number of its text."""
    n = len(c.low)
    letter = _IS_LETTER[c.low]
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(letter, at, -1))
    first = np.minimum.accumulate(np.where(letter, at, n)[::-1])[::-1]
    s, e = first[c.starts], last[c.ends - 1] + 1
    ok = s < e
    doc = np.repeat(np.arange(len(c.offsets) - 1), c.n_words)
    return s[ok], e[ok], doc[ok]


def disguised(c: Chunk) -> list[tuple[int, str, bool]]:
    """(text, word, joined) of the words that have more than one reading; single letters in a row are joined to one."""
    low, n = c.low, len(c.low)
    if not len(c.starts):
        return []
    letter, symbol = _IS_LETTER[low], _IS_SYMBOL[low]
    mark = np.zeros(n, bool)
    mark[:-1] |= symbol[:-1] & letter[1:]
    mark[:-1] |= letter[:-1] & (_IS_DIGIT[low[1:]] | _IS_LAST[low[1:]])
    if n > 2:
        mark[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & (low[:-2] < 128)
    total = np.concatenate(([0], np.cumsum(mark)))
    flagged = np.flatnonzero(total[c.ends] > total[c.starts])
    doc = np.repeat(np.arange(len(c.offsets) - 1), c.n_words)
    raw = low.tobytes()
    out = []
    for i in flagged:
        word = raw[c.starts[i] : c.ends[i]].decode("utf-8", "replace").strip(".,;:?\"')[]#*%&<>=")
        plain = word.strip("!(")
        # What may be a sign or a letter is read both ways.
        out += [(int(doc[i]), x, False) for x in {word, plain}]
    one = (c.ends - c.starts == 1) & _IS_LETTER[low[c.starts]] | (c.ends - c.starts == 1) & _IS_SYMBOL[low[c.starts]]
    runs = np.flatnonzero(one)
    if len(runs) >= 3:
        breaks = np.flatnonzero((np.diff(runs) > 1) | (np.diff(doc[runs]) > 0)) + 1
        for run in np.split(runs, breaks):
            if len(run) >= 3:
                # The whole run, and its parts between wide gaps.
                gaps = c.starts[run[1:]] - c.ends[run[:-1]]
                parts = np.split(run, np.flatnonzero(gaps > gaps.min()) + 1)
                for part in [run, *[x for x in parts if 1 < len(x) < len(run)]]:
                    out.append((int(doc[run[0]]), low[c.starts[part]].tobytes().decode("utf-8", "replace"), True))
    return out


def restored_words(c: Chunk, model: CharModel) -> tuple[np.ndarray, list[bytes]]:
    """Text number and reading of each disguised word."""
    docs, words = [], []
    for doc, word, joined in disguised(c):
        reading = model.restore(word)
        if joined or reading != word:
            for x in {reading, *model.restore_words(word)} - {""}:
                docs.append(doc)
                words.append(x.encode())
    return np.array(docs, np.int64), words


def evidence_keys(c: Chunk, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """For each word: the hash of the word and of its beginnings (0 where it is too short)."""
    keys = [span_hashes(c, s, e) ^ np.uint64(0x77)]
    for k in PREFIXES:
        keys.append(np.where(e - s > k, span_hashes(c, s, np.minimum(s + k, e)), np.uint64(0)))
    return keys


def words_chunk(words: list[bytes]) -> Chunk:
    data = np.frombuffer(b"".join(words), np.uint8)
    c = Chunk(0, len(words), data, np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64))))
    c.low = data
    return c


def all_keys(c: Chunk, model: CharModel | None) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers (rows) and keys (one column each for word and beginnings) of all words, readings included."""
    s, e, doc = cores(c)
    keys = np.stack(evidence_keys(c, s, e), 1) if len(s) else np.zeros((0, 1 + len(PREFIXES)), np.uint64)
    if model is not None:
        more, words = restored_words(c, model)
        if words:
            r = words_chunk(words)
            doc = np.concatenate((doc, more))
            keys = np.concatenate((keys, np.stack(evidence_keys(r, r.offsets[:-1], r.offsets[1:]), 1)))
    return doc, keys


@dataclass
class ToxicityModel:
    chars: CharModel
    keys: np.ndarray  # sorted
    odds: np.ndarray
    beta: np.ndarray | None
    base: float

    def evidence(self, c: Chunk) -> np.ndarray:
        """For each text: strongest word, sum over distinct words, their number and share (each bounded)."""
        n = c.hi - c.lo
        out = np.zeros((n, 4))
        doc, keys = all_keys(c, self.chars)
        if len(self.keys) and len(doc):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            w = np.where(self.keys[at] == keys, self.odds[at], 0.0).max(1)
            hit = np.flatnonzero(w > 0)
            _, one = np.unique(mix(doc[hit].astype(np.uint64) + np.uint64(1)) ^ keys[hit, 0], return_index=True)
            hit = hit[one]
            np.maximum.at(out[:, 0], doc[hit], w[hit])
            np.add.at(out[:, 1], doc[hit], w[hit])
            np.add.at(out[:, 2], doc[hit], 1.0)
        out[:, 3] = out[:, 1] / np.sqrt(np.maximum(c.n_words, 1))
        return np.minimum(out, [6.0, 20.0, 5.0, 5.0])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(evidence), self.base)
        return 1 / (1 + np.exp(-(evidence @ self.beta[1:] + self.beta[0])))


def _train_parts(docs: DataFrame) -> DataFrame:
    """Counts over labelled rows (text, toxic): of features by class, and of character trigrams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for c in chunks(batch.column(0)):
                doc, keys = all_keys(c, None)
                doc, keys = np.repeat(doc, keys.shape[1]), keys.ravel()
                doc, keys = doc[keys != 0], keys[keys != 0]
                _, one = np.unique(mix(doc.astype(np.uint64) + np.uint64(1)) ^ keys, return_index=True)
                key, inverse = np.unique(keys[one], return_inverse=True)
                n = np.bincount(inverse, minlength=len(key))
                bad = np.bincount(inverse, weights=toxic[c.lo : c.hi][doc[one]], minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.nulls(len(key), pa.string()), pa.array(n.astype(np.int64)), pa.array(bad)], names=["feature", "gram", "n", "bad"])
                s, e, _ = cores(c)
                code = np.zeros(256, np.int64)
                code[97:123] = np.arange(1, 27)
                seq = np.where(np.isin(np.arange(len(c.low)), s - 1), 0, code[c.low])
                inside = np.zeros(len(c.low) + 1, np.int64)
                np.add.at(inside, s, 1)
                np.add.at(inside, e, -1)
                word = np.cumsum(inside)[:-1] > 0
                plain = word & (seq > 0)
                x = np.where(plain, seq, 0)
                p1 = np.concatenate(([0], x))[: len(x)]
                p2 = np.concatenate(([0, 0], x))[: len(x)]
                p2 = np.where(p1 == 0, 0, p2)
                grams = np.bincount(((p2 * 27 + p1) * 27 + x)[plain | (p1 > 0)], minlength=27**3)
                some = np.flatnonzero(grams)
                names = ["^" + LETTERS, LETTERS]
                text = [names[0][g // 729] + names[0][g // 27 % 27] + ("$" if g % 27 == 0 else LETTERS[g % 27 - 1]) for g in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(text, pa.string()), pa.array(grams[some].astype(np.int64)), pa.nulls(len(some), pa.int64())], names=["feature", "gram", "n", "bad"])

    return docs.mapInArrow(count, "feature long, gram string, n long, bad long").groupBy("feature", "gram").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def fit_logistic(seen: DataFrame, columns: list[str], n: int, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression of toxic on columns by Newton steps, halved where the loss would rise; the intercept comes
    first. seen: toxic, columns and count; n: the sum of count. A step is one pass, of which one row reaches the driver."""
    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    k, w, shrink = len(x), np.zeros(len(x)), ridge * n / 100
    lowest, before, move = np.inf, w, w
    for _ in range(steps):
        z = sum((F.lit(float(v)) * c for v, c in zip(w[1:], x[1:])), F.lit(float(w[0])))
        step = seen.withColumn("_z", z).withColumn("_p", 1 / (1 + F.exp(-F.greatest(F.least("_z", F.lit(30.0)), F.lit(-30.0)))))
        loss = F.col("count") * (F.greatest("_z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - F.col("toxic") * F.col("_z"))
        gap, spread = F.col("count") * (F.col("toxic") - F.col("_p")), F.col("count") * F.col("_p") * (1 - F.col("_p"))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = step.agg(*[F.sum(gap * c).alias(f"g{i}") for i, c in enumerate(x)], *[F.sum(spread * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs], F.sum(loss).alias("loss")).first()
        now = sums["loss"] + shrink / 2 * w @ w
        if now > lowest + 1e-9 * abs(lowest):
            move = move / 2
            w = before + move
            continue
        lowest, before = now, w
        h = shrink * np.eye(k) + 1e-9 * np.eye(k)
        for (i, j), value in zip(pairs, sums[k:-1]):
            h[i, j] += value
            if i != j:
                h[j, i] += value
        move = np.linalg.solve(h, np.array(sums[:k]) - shrink * w)
        w = before + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit_increasing(seen: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """fit_logistic without negative weights: more evidence never lowers a score."""
    use = np.arange(len(columns))
    while True:
        w = fit_logistic(seen, [columns[i] for i in use], n)
        if not len(use) or (w[1:] >= 0).all():
            out = np.zeros(1 + len(columns))
            out[0], out[1 + use] = w[0], w[1:]
            return out
        use = np.delete(use, w[1:].argmin())


def labelled(documents: DataFrame, marked: DataFrame, key: str, text: str) -> DataFrame:
    """t and toxic of the documents that marked (key, toxic) has, written; a bitmap keeps most other texts out of the join."""
    name = lambda df: F.xxhash64(df[key].cast("string"))
    slim = documents.select(F.col(key), F.col(text).alias("t"))
    near = split_rows(slim.withColumn("_h", name(slim)), marked.select(name(marked).alias("_h")), "_h")[1]
    return written(near.join(marked, key).select("t", "toxic"), "labelled")


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lexicon: int | None = None) -> ToxicityModel:
    """A model from all labelled rows; labels: key and label. The `lexicon` strongest words and beginnings are used (None: all)."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    total, bad = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = bad / total if total else 0.0
    rows = labelled(documents, marked, key, text)
    counts = _train_parts(rows).filter(F.col("gram").isNotNull() | (F.col("bad") >= MIN_ROWS))
    # Log odds of a feature between toxic and other rows.
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (total - bad + 1.0))
    counts = counts.withColumn("odds", odds).filter(F.col("gram").isNotNull() | (F.col("odds") >= MIN_ODDS))
    # Character trigrams are at most 27 ** 3.
    if lexicon is not None:
        counts = counts.orderBy(F.col("gram").isNull(), F.desc(F.col("odds") * F.sqrt("bad")), "feature").limit(27**3 + lexicon)
    got = counts.collect()
    chars = CharModel({r["gram"]: r["n"] for r in got if r["gram"]})
    words = sorted((r["feature"] % 2**64, min(r["odds"], 6.0)) for r in got if r["gram"] is None)
    model = ToxicityModel(chars, np.array([k for k, _ in words], np.uint64), np.array([w for _, w in words]), None, base)
    if 0 < bad < total:
        columns = [f"e{i}" for i in range(4)]
        seen = written(with_evidence(rows, model, ["toxic"], "t").groupBy("toxic", *columns).count(), "evidence")
        kinds = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.sum("count").alias("n")).collect()}
        if len(kinds) == 2:  # labelled rows of both kinds are among the documents
            model.beta = fit_increasing(seen, columns, sum(kinds.values()))
        discard(seen)
    discard(rows)
    return model


def with_evidence(df: DataFrame, model: ToxicityModel, keep: list[str], text: str) -> DataFrame:
    slim = df.select(*keep, F.col(text).cast("string").alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            parts = [model.evidence(c) for c in chunks(batch.column(len(keep)))]
            e = np.concatenate(parts) if parts else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(e)), *[pa.array(np.round(e[:, i], 3)) for i in range(4)]], names=[*keep, "score", "e0", "e1", "e2", "e3"])

    return slim.mapInArrow(run, schema + ", score double, e0 double, e1 double, e2 double, e3 double")


def scored(documents: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, score and predicted of every document."""
    out = with_evidence(documents, model, [key, *keep], text)
    return out.select(key, *keep, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def in_fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels").filter(~in_fold()))
    return scored(documents, model).select("doc_id", in_fold().alias("held_out"), "score", "predicted")


def without_toxic(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows of df whose score is below THRESHOLD, with all their columns."""
    marked = df.withColumn(fresh(df, "_text"), F.col(text).cast("string"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            scores = [np.zeros(0), *[model.score(model.evidence(c)) for c in chunks(batch.column(batch.num_columns - 1))]]
            rows = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            yield rows.filter(pa.array(np.concatenate(scores) < THRESHOLD))

    return marked.mapInArrow(keep, df.schema)
