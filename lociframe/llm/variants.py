"""Grouping of spelling variants over a bit-sliced position index.

Words that differ by one inserted, deleted or replaced code point are near. Vocabulary rows stand in blocks; for each
(position, letter) a block has one bitset of the rows with that letter there. A query word is read letter by letter, for
all queries of a block at once: one set tracks rows equal so far, three track rows with one error so far (replaced, or the
row one letter longer or shorter, read at shifted positions), each step a handful of word-parallel operations.

The vocabulary is never in one place. Two near words of l and l or l + 1 letters share p letters in front and s behind with
p + s >= l - 1; so for any split of a stretch [a, b) of l places in two, the words agree outside one of its halves. Rows
start in two halves of [0, l), and a group (same l, stretch and letters outside) of more than `group` rows is split again,
as often as needed, until it is small or its stretch is one letter, where the alphabet bounds it. A pair is counted in one
stretch only, that of its first difference. No pairs are emitted: a row leaves its group with the number of its near words
and the most frequent of them, which are summed by word.

Defined edge cases: a null or empty text has no words; a null key is hashed as an empty one; repeated rows count each;
words differ if their code points do (only A-Z are lower-cased); extra columns are ignored; an empty table gives an empty
result. Words of any length take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import discard, table, written, written_count
from .text import _LOWER, raw_chunks

#: Least code points and occurrences of a word; how many times as frequent a form is.
LETTERS, OCCURS, TIMES = 6, 5, 5
#: One run in MISSPELT, by its hash, loses a letter (the planted misspellings of the query); 0 turns this off.
MISSPELT = 199
#: Rows of a group above which its stretch is split; rows of a block of small groups; cells (rows x letters) of a block.
GROUP, ROWS, CELLS = 4096, 1024, 1 << 19
#: Queries read at a time.
QUERIES = 512
#: Bytes of words that are counted together before they leave a task.
COUNTED = 16 << 20


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and text of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (0xC3 and any second byte)."""
    n = len(data)
    inside = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    two = np.flatnonzero(data == 0xC3)
    inside[two] = True
    inside[two + 1] = True
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: The inverted crc32 goes from c to _STEP[(c ^ b) & 255] ^ (c >> 8) by a byte b; it is all ones before the first.
_STEP = ~np.array([zlib.crc32(bytes([255 ^ i])) for i in range(256)], np.uint32) ^ np.uint32(0x00FFFFFF)


def run_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run, going on from the crc32 of what stands before it (state)."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, crc = starts[order], ~state[order]
    counts = len(order) - np.searchsorted(np.sort(length), np.arange(1, 65))  # runs of at least 1, 2, ... bytes
    for i, k in enumerate(counts.tolist()):
        if not k:
            break
        crc[:k] = _STEP[(crc[:k] ^ low[at[:k] + i]) & np.uint32(255)] ^ (crc[:k] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(length > 64):
        out[i] = zlib.crc32(low[starts[i] : ends[i]], int(state[i]))
    return out


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings."""
    length = ends - starts
    offsets = np.concatenate(([0], np.cumsum(length)))
    at = np.repeat(starts - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes()))


def _words(c, keys: list[str], letters: int, misspelt: int) -> list[pa.Array]:
    """Words of at least `letters` code points of a chunk."""
    low = _LOWER[c.data]
    starts, ends, text = _runs(low, c.offsets)
    inner = np.concatenate(([0], np.cumsum((low & 0xC0) == 0x80)))
    points = ends - starts - (inner[ends] - inner[starts])
    keep = points >= letters
    out = []
    if misspelt and len(starts):
        state = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
        h = run_hashes(low, starts, ends, state[text])
        hit = h % np.uint32(misspelt) == 0
        keep &= ~hit
        words = []
        for i in np.flatnonzero(hit & (points > letters)):
            word, at = low[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(points[i])
            words.append(word[:at] + word[at + 1 :])
        out.append(pa.array(words, pa.large_string()))
    return [*out, _spans(low, starts[keep], ends[keep])]


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, occurs: int = OCCURS, misspelt: int = MISSPELT) -> DataFrame:
    """word and n of every word of the texts with at least `letters` code points and `occurs` occurrences.

    Tasks count before they send: a word moves once for each COUNTED bytes of words of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[pa.Array]) -> pa.RecordBatch:
            got = pa.chunked_array(held, pa.large_string()).combine_chunks().value_counts()
            return pa.RecordBatch.from_arrays([got.field("values").cast(pa.string()), got.field("counts")], names=["word", "n"])

        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).fill_null("").to_pylist()
            for c in raw_chunks(batch.column(1)):
                new = _words(c, keys[c.lo : c.hi], letters, misspelt)
                held += new
                size += sum(x.nbytes for x in new)
                if size > COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    slim = df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurs)


def _stretch(low: Column, high: Column) -> Column:
    """A row of a group: word, n, what the group shares (l, stretch and letters outside it) and the letters inside."""
    behind = F.col("l") - high
    inside = F.expr("length(word)") - low - behind
    return F.struct(
        "word", "n", "l", low.alias("a"), high.alias("b"),
        F.concat(F.substring("word", F.lit(1), low), F.lit("|"), F.substring("word", low + inside + 1, behind)).alias("outside"),
        F.substring("word", low + 1, inside).alias("inside"),
    )


def _halves(rows: DataFrame) -> DataFrame:
    """Rows (word, n, l, a, b) in both halves of their stretch."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    return rows.select(F.explode(F.array(_stretch(F.col("a"), mid), _stretch(mid, F.col("b")))).alias("r")).select("r.*")


_GROUP = ["l", "a", "b", "outside"]


def grouped(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """Rows of all groups with more than one word, none with more than `group` rows unless its stretch is one letter."""
    size = F.char_length("word")
    first = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("l")).filter("l > 1").select("*", F.lit(0).alias("a"), F.col("l").alias("b"))
    parts, rows = [], written(_halves(first), "variants-rows")
    while True:
        sizes = rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("size"))
        large, n = written_count(sizes.filter((F.col("size") > group) & (F.col("b") - F.col("a") > 1)).select(*_GROUP), "variants-large")
        if not n:
            discard(large)
            parts.append(rows)
            break
        parts.append(rows.join(large, _GROUP, "left_anti"))
        rows = written(_halves(rows.join(large, _GROUP, "left_semi").select("word", "n", "l", "a", "b")), "variants-rows")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Block:
    """Bit-sliced index of some rows, of whole groups: `inside` letters, group number of each row (ascending)."""

    def __init__(self, inside: list[str], group: np.ndarray):
        self.n = len(inside)
        self.length = np.array([len(x) for x in inside])
        self.group = group
        self.places = int(self.length.max(initial=0))
        codes = np.frombuffer("".join(inside).encode("utf-32-le"), np.uint32)
        self.alphabet, code = np.unique(codes, return_inverse=True)
        row = np.repeat(np.arange(self.n), self.length)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.letters = np.zeros((self.n, self.places + 1), np.int64)
        self.letters[row, place] = code
        self.bits = np.zeros((self.places + 1, len(self.alphabet) + 1, self._bytes), np.uint8)
        # One bit for each letter of the rows; rows of one (place, letter, byte) are combined.
        np.bitwise_or.at(self.bits, (place, code, row >> 3), (1 << (row & 7)).astype(np.uint8))
        self.bits = self.bits.view(np.uint64)
        self.of_length = self._sets(self.length, self.places + 2)
        self.lasting = np.stack([self._set(self.length > i) for i in range(self.places + 1)])

    @property
    def _bytes(self) -> int:
        return -(-self.n // 64) * 8

    def _set(self, mask: np.ndarray) -> np.ndarray:
        out = np.zeros(self._bytes, np.uint8)
        packed = np.packbits(mask, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def _sets(self, value: np.ndarray, n: int) -> np.ndarray:
        return np.stack([self._set(value == i) for i in range(n)])

    def near(self, rows: np.ndarray, width: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rows near each of some rows, as bitsets. width: letters of the stretch of a row (its words have these, or one more);
        last: whether the stretch ends with the word. Rows with one letter more look only for rows with one less."""
        order = np.argsort(-self.length[rows], kind="stable")
        q = rows[order]
        t = self.length[q]
        first = np.searchsorted(self.group, self.group[q], side="left")
        end = np.searchsorted(self.group, self.group[q], side="right")
        every = np.arange(self._bytes * 8)
        own = np.packbits((every >= first[:, None]) & (every < end[:, None]), axis=1, bitorder="little").view(np.uint64)
        same, swapped, longer, shorter = own.copy(), np.zeros_like(own), np.zeros_like(own), np.zeros_like(own)
        prior = own.copy()
        for i in range(int(t.max(initial=0))):
            k = int(np.searchsorted(-t, -i, side="left"))  # queries with more than i letters
            letter = self.letters[q[:k], i]
            here, next_ = self.bits[i, letter], self.bits[min(i + 1, self.places), letter]
            z = same[:k].copy()
            prior[:k] = z
            same[:k] = z & here
            swapped[:k] = (swapped[:k] & here) | (z & self.lasting[i])
            longer[:k] = (longer[:k] | z) & next_
            shorter[:k] = z if i == 0 else (shorter[:k] & self.bits[i - 1, letter]) | z
        plain = (t == width[order])[:, None]
        ends = last[order][:, None]
        less = np.where((t > 0)[:, None], self.of_length[np.maximum(t - 1, 0)], np.uint64(0))
        one = (swapped & self.of_length[t] & ~same) | np.where(ends, longer | same, longer & ~same) & self.of_length[t + 1]
        other = np.where(ends, shorter, shorter & ~prior) & less
        out = np.empty_like(own)
        out[order] = np.where(plain, one, other)
        return out


def _first_bit(sets: np.ndarray) -> np.ndarray:
    """Number of the lowest bit of each row of sets, which has one."""
    word = (sets != 0).argmax(1)
    x = sets[np.arange(len(sets)), word]
    return word * 64 + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows in order of group, most frequent and then least word first: each row's near words of its group."""
    names = ["word", "n_near", "near", "near_n"]

    def answer(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = Block(rows.column("inside").to_pylist(), group)
        a, b, size = (rows.column(x).to_numpy() for x in ("a", "b", "l"))
        word, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
        for part in np.array_split(np.arange(len(group)), -(-len(group) // QUERIES)):
            sets = block.near(part, (b - a)[part], (b == size)[part])
            found = np.flatnonzero(sets.any(1))
            if len(found):
                best = pa.array(_first_bit(sets[found]))
                count = np.bitwise_count(sets[found]).sum(1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([word.take(pa.array(part[found])), pa.array(count), word.take(best), n.take(best)], names=names)

    def blocks(rows: pa.Table, ended: bool) -> tuple[list[tuple[pa.Table, np.ndarray]], pa.Table]:
        """Blocks of whole groups, and the rows of the last group, which may go on, unless the input has ended."""
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for name in _GROUP:
            x = rows.column(name).combine_chunks()
            new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
        starts = np.append(np.flatnonzero(new), rows.num_rows)
        if not ended:
            starts = starts[:-1]
        length = pc.utf8_length(rows.column("inside")).to_numpy()
        sizes = np.diff(starts)
        out, held, cells = [], [], 0

        def close() -> None:
            take = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in held])
            out.append((rows.take(pa.array(take)), np.repeat(np.arange(len(held)), sizes[held])))
            held.clear()

        n = 0
        for g in np.flatnonzero(sizes > 1).tolist():  # a word alone in its group has no near word there
            widest = int(length[starts[g] : starts[g + 1]].max()) + 1
            if held and (n + sizes[g] > ROWS or (n + sizes[g]) * max(cells, widest) > CELLS):
                close()
                n = cells = 0
            held.append(g)
            n, cells = n + int(sizes[g]), max(cells, widest)
        if held:
            close()
        return out, rows.slice(int(starts[-1]) if len(starts) else 0)

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        done, rest = blocks(rows, False)
        for block in done:
            yield from answer(*block)
    if rest is not None and rest.num_rows:
        for block in blocks(rest, True)[0]:
            yield from answer(*block)


def near_words(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n_near (how many words are near it), near (of these the most frequent, of equals the least) and near_n, for the
    words of the vocabulary (word, n; each once) that have a near one."""
    rows = grouped(vocabulary, group).repartition(*_GROUP).sortWithinPartitions(*_GROUP, F.desc("n"), "word")
    found = rows.mapInArrow(_near_words, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.near", (-F.col("best.m")).alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the form of the form, and so on, by doubling. Forms must not lead in a circle."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("on"))
        joined = roots.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved"))
        roots, moved = written_count(joined, "variants-roots", F.col("moved"))
        roots = roots.select("word", "root")
        if not moved:
            return roots


def spelling_variants(vocabulary: DataFrame, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form (its most frequent near word, if `times` as frequent or more), form_n and root (from word, forms
    followed to the last) of every word of the vocabulary (word, n)."""
    words = written(vocabulary.select("word", "n"), "variants-words")
    near = words.join(near_words(words, group), "word", "left")
    form = F.when(F.col("near_n") >= times * F.col("n"), F.col("near"))
    near = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("near_n")).alias("form_n")), "variants-near")
    roots = rooted(near.filter("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spelling_variants(word_counts(table(spark, sf_dir, "documents")))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
