"""Personal data in text: exact patterns, and a linear-chain conditional random field that adds what they miss.

Base spans are those of four patterns, per kind leftmost and non-overlapping, each found in one pass over the text. The
random field labels words by their shape (lengths, classes of characters, symbols inside) and their neighbours' kinds.
Words of plain letters are always outside, so a text falls into independent runs of other words; runs of equal length are
decoded together by a Viterbi pass over numpy arrays. The field is trained by gradient ascent on the exact likelihood
(forward-backward) of a small labelled table, LABELLED, whose rows stand for forms that the patterns know, forms they
miss (no plus sign, other separators, no top-level domain, colons; tokens, account numbers) and numbers that are no
personal data. Its spans are
added where they overlap no base span, if they have the digits or the sign that their kind needs.

Defined edge cases: a null or empty text has no spans; repeated rows each give a row; extra columns are ignored; a run of
any length is decoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import table
from .text import raw_chunks, release

#: The labelled table: runs of words as written, personal data in braces with its kind. `#` is any digit, `L` a run of
#: letters, `X` a hexadecimal digit, `B` a number up to 255, `C` sixteen digits that pass the check sum in groups of four.
LABELLED = """
{email L@L.org} | {email L.L@L.com} | {email L_##@L.co.L} | mail={email L@L.net} | {email L@L} | {email L@L} | {email L.L@L} | {email L##@L} | {email L##@L} | {email L@L.L} {phone +1 (###) ###-####} | @L | L@ | ##@ | @L## | #+# | L+L# | +#
{ip B.B.B.B} | {ip B.B.B.B} {ip B.B.B.B} | {ip ####:XXX::##} | {ip XXXX:XXXX:##:#::X} | {ip ::#} | {ip ::#} | {ip ::##} | {ip XXXX::#:X} | #.#.# | #.## | ##.#.## | #.#.#.#.# | ##:## | ##:##:## | #:# | L-#.#.# | v#.#
{card C} | {card C0} | {card C.} | {card C-} | {card C0} ##/## | {card C.} ##/## ### | {card C_} | {card C/} | {card C} | {card C} ##/## | {account ################} | {account ###############} | {account ################} {account ################} | {account ##################} | #################### | ####-##-## | ##/##/#### | ##.##.#### | #### #### | ###### | ####################### | #,###,### | ### ####
{phone +1 ### ### ####} | {phone +## ### ######} | {phone (###) ###-####} | {phone ###-###-####} | {phone ###.###.####} | {phone ### ### ####} | {phone 00## ### ######} | {phone 0## ########} | {phone (0###) ######} | {phone 1-###-###-####} | {phone 1-###-###-####} | {phone (###)###-####} | {phone ###/###-####} | ###-#-###-#####-# | ##-###-####-# | #-### | ##-## | ####-#### | ###.## | (####) | (#) | #.###.###
{secret XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX} | {secret XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX} | {secret key=XLXXXLXXXLXXXLXXXXLX#} | {secret LLL##LLL#LLL###LLL#} | {secret sk-L##LL###LLL#LL####} | {secret XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX} {secret XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX} | L-##-L-L | LLL# | LL#L#
# | ## | ### | #### | ##### | L# | L## | #L | ##L | L-# | #% | $## | #.# | # ## | ## ### | #x# | #/# | ##,## | (##) | L=# | #-L | L#L | ##L## | L####### | ####### | ##-##-## ## | ########## | ############
#### {phone (###) ###-####} # | #### #### {phone (###) ###-####} # # | ## {phone ###-###-####} ## | # {phone ###.###.####} L# | ### {card C.} ## | #### {ip ::#} ## | # # # # # # | #### #### #### | # {phone +1 ### ### ####} L# | ## {email L@L} #
"""
#: Times that each row of the table is filled in for training.
FILLED = 12

#: The base patterns, in the order in which spans are listed.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: Kinds that only the field finds: keys and tokens, and long numbers that fail the check of cards.
MORE = ["secret", "account"]
_RE = {k: re.compile(p) for k, p in PATTERNS.items()}
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOTTED = re.compile(r"[0-9]+(\.[0-9]+)*")
LABELS = ["O", *[f"{p}-{k}" for k in KINDS + MORE for p in "BI"]]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    if kind == "card":
        d = s.replace(" ", "").replace("-", "")
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_DIGITS.findall(s)) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern: a local part reaches from the last other character to an @, so each @ is tried once."""
    out, free = [], 0  # free: where a local part may begin at the earliest
    at = text.find("@")
    while at >= 0:
        local = text[free:at]
        start = free + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def dotted_quads(text: str) -> list[tuple[int, int]]:
    """Matches of the ip pattern: every four numbers of a maximal run of numbers and single dots."""
    out = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            start, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                end = start + sum(map(len, parts[i : i + 4])) + 3
                out.append((start, end))
                start = end + 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            out += [("ip", s, e) for s, e in dotted_quads(text) if _valid("ip", text[s:e])]
        for kind in ("card", "phone"):
            if kind == "card" or "+" in text:
                out += [(kind, m.start(), m.end()) for m in _RE[kind].finditer(text) if _valid(kind, m.group())]
    return out


def runs(text: str) -> list[list[tuple[int, int, str]]]:
    """Maximal runs of words with a digit, @ or +, each word stripped of the punctuation around it."""
    out: list[list[tuple[int, int, str]]] = []
    last = -1
    for i, m in enumerate(_WORD.finditer(text)):
        w = m.group()
        if not _SPECIAL.search(w):
            continue
        core = w.rstrip(_AROUND + ":").lstrip(_AROUND)
        core = core if core[:2] == "::" else core.lstrip(":")
        if not _SPECIAL.search(core):
            continue
        s = m.start() + w.index(core)
        if out and last == i - 1:
            out[-1].append((s, s + len(core), core))
        else:
            out.append([(s, s + len(core), core)])
        last = i
    return out


_AROUND = ".,;!?\"'[]<>{}#*$%&|"
_SPECIAL = re.compile(r"[0-9@+]")
_SHAPES = [
    re.compile(p)
    for p in (r"@", r"^[^@]+@[^@]+$", r":", r"^\+", r"^\+?[0-9]{1,3}$", r"^\([0-9]{2,4}\)$", r"^[0-9]{3}[.-][0-9]{4}$", r"^[0-9]{3,4}$", r"^[0-9]{4}$", r"^[0-9]{16,19}$", r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", r"^[0-9]{1,3}(\.[0-9]{1,3}){1,2}$", r"^[0-9]+$", r"-", r"\.", r"/", r"_", r"[G-Zg-z]", r"::", r"^[0-9]{3}$", r"^0[0-9]+$", r"^[0-9]{10,15}$", r"^[0-9]{3}[./-][0-9]{3}[.-][0-9]{4}$", r"^[0-9A-Fa-f:]+$", r"^(?:[0-9]+[.,-])*[0-9]+$", r"^[0-9]{1,2}[:/.-]", r"^1-[0-9]{3}-[0-9]{3}-", r"^::", r"^[0-9A-Fa-f]{32,64}$", r"^[0-9A-Za-z+/_=-]{20,}$", r"^[0-9]{14,19}$", r"^[0-9]{20,}$", r"[()]", r"^([0-9]{4}[-.]){3}[0-9]{4}$", r"^[0-9.()-]{8,}$", r"=", r"[A-Z]", r"^[0-9]{8,15}$")
]
N_FEATURES = len(_SHAPES) + 8


def features(word: str) -> np.ndarray:
    x = np.zeros(N_FEATURES)
    for i, p in enumerate(_SHAPES):
        x[i] = p.search(word) is not None
    digits = len(_DIGITS.findall(word))
    at = word.find("@")
    x[-8:] = [14 <= digits <= 19 and luhn("".join(_DIGITS.findall(word))), 1.0, min(len(word), 40) / 20, min(digits, 20) / 10, digits == len(word), digits == 0, 0 < digits and re.search("[A-Za-z]", word) is not None, 0 < at < word.rfind(".")]
    return x


@dataclass
class Field:
    emit: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels
    start: np.ndarray

    @staticmethod
    def zero() -> Field:
        k = len(LABELS)
        return Field(np.zeros((N_FEATURES, k)), _allowed(np.zeros((k, k))), _allowed_start(np.zeros(k)))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best labels of runs of equal length; x: runs x words x features."""
        score = x @ self.emit
        best = self.start + score[:, 0]
        back = []
        for t in range(1, x.shape[1]):
            step = best[:, :, None] + self.move
            back.append(step.argmax(1))
            best = step.max(1) + score[:, t]
        out = np.zeros(x.shape[:2], np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(x.shape[1] - 2, -1, -1):
            out[:, t] = back[t][np.arange(len(x)), out[:, t + 1]]
        return out

    def expected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected feature, transition and start counts under the model (forward-backward), for runs of one length."""
        score = x @ self.emit
        n, length, k = score.shape
        alpha, beta = np.zeros((n, length, k)), np.zeros((n, length, k))
        alpha[:, 0] = self.start + score[:, 0]
        for t in range(1, length):
            alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + self.move, 1) + score[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = np.logaddexp.reduce(self.move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = np.logaddexp.reduce(alpha[:, -1], 1)[:, None, None]
        p = np.exp(alpha + beta - z)
        move = np.zeros((k, k))
        for t in range(1, length):
            move += np.exp(alpha[:, t - 1, :, None] + self.move + (score[:, t] + beta[:, t])[:, None, :] - z).sum(0)
        return np.einsum("ntf,ntk->fk", x, p), move, p[:, 0].sum(0)


def _allowed(move: np.ndarray) -> np.ndarray:
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b.startswith("I-") and a[2:] != b[2:]:
                move[i, j] = -1e4
    return move


def _allowed_start(start: np.ndarray) -> np.ndarray:
    for j, b in enumerate(LABELS):
        if b.startswith("I-"):
            start[j] = -1e4
    return start


def _check_digit(digits: str) -> str:
    return next(d for d in "0123456789" if luhn(digits + d))


def filled(row: str, seed: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A row of LABELLED as text, and its spans."""
    text, spans, kind, begin = "", [], "", 0
    for token in re.findall(r"\{[a-z]+ |\}|C.?|.", row):
        if token[0] == "{" and len(token) > 1:
            kind, begin = token[1:-1], len(text)
        elif token == "}":
            spans.append((kind, begin, len(text)))
        elif token[0] == "C" and kind == "card":
            d = str(seed.randrange(3, 7)) + "".join(str(seed.randrange(10)) for _ in range(14))
            d += _check_digit(d)
            sep = {"0": " ", "}": ""}.get(token[1:], token[1:])
            text += sep.join(d[i : i + 4] for i in range(0, 16, 4))
            if token[1:] == "}":
                spans.append((kind, begin, len(text)))
        else:
            text += {"#": lambda: str(seed.randrange(10)), "L": lambda: "".join(seed.choice("abcdefghijklmnoprstuvw") for _ in range(seed.randrange(2, 9))), "X": lambda: seed.choice("0123456789abcdef"), "B": lambda: str(seed.randrange(256))}.get(token, lambda t=token: t)()
    return text, spans


def labelled_run(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[list[str], list[int]]]:
    """Runs of words of a text and their labels by its spans."""
    out = []
    for run in runs(text):
        y, last = [], None
        for s, e, _ in run:
            hit = next((x for x in spans if x[1] < e and s < x[2]), None)
            y.append(0 if hit is None else LABELS.index(("I-" if hit == last else "B-") + hit[0]))
            last = hit
        out.append(([w for _, _, w in run], y))
    return out


def fit(data: list[tuple[list[str], list[int]]], steps: int = 300, rate: float = 0.3, ridge: float = 1e-3) -> Field | None:
    """Gradient ascent (Adam) on the mean log likelihood of labelled runs."""
    if not data:
        return None
    by: dict[int, tuple[list, list]] = {}
    for words, y in data:
        xs, ys = by.setdefault(len(words), ([], []))
        xs.append(np.stack([features(w) for w in words]))
        ys.append(y)
    k = len(LABELS)
    groups = [(np.stack(x), np.eye(k)[np.array(y)]) for x, y in by.values()]
    seen_emit = sum(np.einsum("ntf,ntk->fk", x, y) for x, y in groups)
    seen_move = sum(np.einsum("nti,ntj->ij", y[:, :-1], y[:, 1:]) for _, y in groups)
    seen_start = sum(y[:, 0].sum(0) for _, y in groups)
    field, n = Field.zero(), len(data)
    params = [field.emit, field.move, field.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        got = [field.expected(x) for x, _ in groups]
        for i, (p, seen) in enumerate(zip(params, (seen_emit, seen_move, seen_start))):
            g = (seen - sum(e[i] for e in got)) / n - ridge * np.where(np.abs(p) < 1e3, p, 0)
            g[np.abs(p) > 1e3] = 0
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            p += rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-6)
    return field


def _plausible(kind: str, s: str) -> bool:
    digits = len(_DIGITS.findall(s))
    if kind == "email":
        return "@" in s[1:-1]
    if kind == "card":
        return 16 <= digits <= 19 and luhn("".join(_DIGITS.findall(s)))
    if kind == "phone":
        return 10 <= digits <= 15 and digits < len(s) and re.fullmatch(r"[+0-9().\x20/-]+", s) is not None
    if kind == "account":
        return 14 <= len(s) <= 19 and digits == len(s)
    if kind == "secret":
        return len(s) >= 20 and digits > 0 and re.search("[A-Za-z]", s) is not None and re.fullmatch(r"[0-9A-Za-z+/_=.:-]+", s) is not None
    try:
        return s.count(":") > 1 and ipaddress.IPv6Address(s) is not None
    except ValueError:
        return False


def _merged(spans: list[tuple[str, int, int]]) -> list[list[int]]:
    """Disjoint intervals that the spans cover, in order."""
    out: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _overlaps(intervals: list[list[int]], start: int, stop: int) -> bool:
    at = bisect_left(intervals, [stop])
    return at > 0 and intervals[at - 1][1] > start


def added_spans(texts: list[str], found: list[list[tuple[str, int, int]]], field: Field | None) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds and that overlap no base span, for each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if field is None:
        return out
    taken = [_merged(x) for x in found]
    by: dict[int, list[tuple[int, list]]] = {}
    for i, t in enumerate(texts):
        if _SPECIAL.search(t):
            for run in runs(t):
                by.setdefault(len(run), []).append((i, run))
    for length, group in by.items():
        step = max(1, 40_000 // length)
        for lo in range(0, len(group), step):
            part = group[lo : lo + step]
            y = field.decode(np.stack([np.stack([features(w) for _, _, w in run]) for _, run in part]))
            for (i, run), labels in zip(part, y):
                j = 0
                while j < len(run):
                    label = LABELS[labels[j]]
                    if label == "O":
                        j += 1
                        continue
                    e = j + 1
                    while e < len(run) and LABELS[labels[e]] == "I-" + label[2:]:
                        e += 1
                    kind, s, stop = label[2:], run[j][0], run[e - 1][1]
                    j = e
                    if _plausible(kind, texts[i][s:stop]) and not _overlaps(taken[i], s, stop):
                        out[i].append((kind, s, stop))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: ((KINDS + MORE).index(x[0]), x[1], x[2])))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


@functools.cache
def train(seed: int = 0) -> Field:
    """The field fitted on LABELLED, each row FILLED times."""
    r = random.Random(seed)
    rows = [x.strip() for line in LABELLED.strip().split("\n") for x in line.split(" | ")]
    return fit([run for row in rows for _ in range(FILLED) for run in labelled_run(*filled(row, r))])


def find_pii(df: DataFrame, field: Field | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", mask: bool = False) -> DataFrame:
    """keep, counts and digest of base spans, all spans, and those of MORE kinds (others) of every row; with mask also the
    text without any of them."""
    slim = df.select(*keep, F.col(text).cast("string").alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1])
    extra = ", n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, others string" + ", masked string" * mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, *[x.split()[0] for x in extra[2:].split(", ")]]
        for batch in batches:
            for c in raw_chunks(batch.column(len(keep))):
                # Words with a digit, @ or + are all that either finder looks at.
                hot = np.concatenate(([0], np.cumsum(((c.data >= 48) & (c.data <= 57)) | (c.data == 64) | (c.data == 43))))[c.offsets]
                texts = [c.text(i) if mask or hot[i + 1] > hot[i] else "" for i in range(c.hi - c.lo)]
                base = [base_spans(t) for t in texts]
                spans = [b + a for b, a in zip(base, added_spans(texts, base, field))]
                columns = [x.slice(c.lo, c.hi - c.lo) for x in batch.columns[: len(keep)]]
                columns += [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), *[pa.array([joined([x for x in s if (x[0] in KINDS) == own]) for s in spans], pa.string()) for own in (True, False)]]
                if mask:
                    columns.append(pa.array([masked(t, s) if s else t for t, s in zip(texts, spans)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return slim.mapInArrow(run, schema + extra)


def without_pii(df: DataFrame, field: Field | None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """df with the spans of its texts masked; a length column, if there, follows. Null texts stay null."""
    at = df.columns.index(text)
    long = df.columns.index(length) if length in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch.column(at).to_pylist(), batch.column(long).to_pylist() if long is not None else None
            hot = [i for i, t in enumerate(texts) if t and _SPECIAL.search(t)]
            for lo in range(0, len(hot), 500):
                part = hot[lo : lo + 500]
                base = [base_spans(texts[i]) for i in part]
                for i, b, a in zip(part, base, added_spans([texts[i] for i in part], base, field)):
                    if a or b:
                        texts[i] = masked(texts[i], b + a)
                        if sizes is not None:
                            sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes is not None:
                columns[long] = pa.array(sizes, batch.schema.field(long).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            del texts, columns, batch
            release()

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return find_pii(documents, train())
