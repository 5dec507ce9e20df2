"""Order-preserving packing of documents into fixed-length training sequences by dynamic programming.

Each input partition is one stream of documents in scan order. Cuts may fall at document ends (free), sentence ends
(a small penalty) or inside long sentences (a larger one). The best cuts minimise
padding plus penalties; as the padding of a window is linear in its start, the best start within the last `length`
tokens is the head of a monotone queue, so the plan costs O(cuts). Lengths that need no padding (powers of two) are
tried as extra transitions. After each chunk of texts, the cuts that the best plans of all continuations share are placed,
and only what follows them is held; so a stream's plan does not depend on the chunks.

Defined edge cases: a null or empty text is its end token alone; repeated rows and ids are packed as often as they
occur, rows with a null id too (their pieces have a null id); extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .tables import table
from .text import _SPACE, Chunk, chunks, release, span_hashes

LENGTH = 1024
END_ID = 0
#: Token costs of a cut at a sentence end, of one inside a sentence, and of opening a sequence.
SENTENCE_CUT, INNER_CUT, OPEN = 2, 12, 2
#: Sentences of more tokens than this may also be cut inside, every so many tokens.
LONG, INNER_STEP = 64, 16
#: Window lengths without padding that are worth a sequence of their own.
UNPADDED = (128, 256, 512)
#: Distinct word forms whose ids a task remembers before it starts anew.
CACHE = 150_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_backs(pos: list[int], penalty: list[int], length: int = LENGTH, unpadded: tuple[int, ...] = UNPADDED) -> list[int]:
    """For each index into pos, that of the cut before it in the cheapest plan up to it; neighbours in pos lie within
    length."""
    n = len(pos)
    unpadded = tuple(x for x in unpadded if x <= length)
    cost, back = [0] * n, [0] * n
    at = {p: i for i, p in enumerate(pos)}
    queue: deque[tuple[int, int]] = deque([(pos[0], 0)])  # (cost + position, index), increasing
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0][1]] < p - length:
            queue.popleft()
        key, i = queue[0]
        best = key + length - p
        for size in unpadded:
            k = at.get(p - size)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += penalty[j] + OPEN
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    return back


def path(back: list[int], end: int) -> list[int]:
    out = [end]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def best_cuts(pos: list[int], penalty: list[int], length: int = LENGTH, unpadded: tuple[int, ...] = UNPADDED) -> list[int]:
    """Indexes into pos of the cheapest cuts, first and last included; neighbours in pos lie within length."""
    return path(best_backs(pos, penalty, length, unpadded), len(pos) - 1)


def settled(pos: list[int], back: list[int], length: int) -> int:
    """The last cut that the best plans of all continuations share: those go on from cuts in the last `length` tokens."""
    live = {i for i in range(len(pos) - 1, -1, -1) if pos[i] > pos[-1] - length}
    heap = [-i for i in live]
    heapq.heapify(heap)
    while len(heap) > 1:
        before = back[-heapq.heappop(heap)]
        if before not in live:
            live.add(before)
            heapq.heappush(heap, -before)
    return -heap[0]


@functools.cache
def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of all texts of a chunk; distinct pre-token runs are encoded once and remembered within bounds."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The same vocabulary and merges as ranks: same ids, an order of magnitude faster on single words.
        ranks = {bytes(map(byte_of().__getitem__, piece)): i for piece, i in self.tokenizer.get_vocab(False).items() if set(piece) <= byte_of().keys()}
        ranks = {k: i for k, i in ranks.items() if i not in self.tokenizer.get_added_tokens_decoder()}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_feed = self.words.encode_ordinary("\n")[0]
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.arena, self.used = np.empty(1 << 20, np.uint32), 0

    def remember(self, keys: list[int], texts: list[bytes], joinable: np.ndarray) -> None:
        """Encodes and keeps runs. Those that are joinable (a word, with a space before it or not) go in one call, parted by
        line feeds: the pattern parts a line feed from what stands around it, and no word has one."""
        parts = [np.zeros(0, np.uint32)]
        one, rest = np.flatnonzero(joinable).tolist(), np.flatnonzero(~joinable).tolist()
        end = self.used
        if one:
            ids = np.array(self.words.encode_ordinary((b"\n".join([texts[i] for i in one]) + b"\n").decode("utf-8", "replace")), np.uint32)
            stops = np.flatnonzero(ids == self.line_feed)
            sizes = np.diff(stops, prepend=-1) - 1
            for i, stop, size in zip(one, (end + np.cumsum(sizes)).tolist(), sizes.tolist()):
                self.known[keys[i]] = stop - size << 32 | size
            parts.append(ids[ids != self.line_feed])
            end += len(parts[-1])
        flat: list[int] = []
        for i in rest:
            text = texts[i].decode("utf-8", "replace")
            ids = self.words.encode_ordinary(text) if len(text) < 64 else self.tokenizer.encode(text, add_special_tokens=False).ids
            self.known[keys[i]] = end + len(flat) << 32 | len(ids)
            flat += ids
        parts.append(np.array(flat, np.uint32))
        new = np.concatenate(parts)
        end = self.used + len(new)
        if end > len(self.arena):
            self.arena = np.concatenate((self.arena[: self.used], np.empty(max(2 * end, 1 << 20), np.uint32)))
        self.arena[self.used : end] = new
        self.used = end

    def spans(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans that the tokenizer's pattern never joins: words with the one space before them, and the
        rest of the white space. Texts with other Unicode white space are one span each."""
        data, n_docs = c.data, len(c.offsets) - 1
        doc = np.repeat(np.arange(n_docs), c.n_words)
        before = np.empty(len(c.starts), np.int64)
        before[1:] = c.ends[:-1]
        first = c.words[:-1][c.n_words > 0]
        before[first] = c.offsets[:-1][c.n_words > 0]
        gap = c.starts - before
        spaced = (gap > 0) & (data[np.maximum(c.starts - 1, 0)] == 0x20)
        odd = self.odd(c)
        plain = ~odd[doc]
        run = plain & (gap >= 2)
        one = plain & (gap >= 1) & ~spaced
        last = np.where(c.n_words > 0, c.ends[np.maximum(c.words[1:] - 1, 0)] if len(c.ends) else 0, c.offsets[:-1])
        tail = ~odd & (last < c.offsets[1:])
        whole = odd
        starts = np.concatenate((before[run], c.starts[one] - 1, (c.starts - spaced)[plain], last[tail], c.offsets[:-1][whole]))
        ends = np.concatenate((c.starts[run] - 1, c.starts[one], c.ends[plain], c.offsets[1:][tail], c.offsets[1:][whole]))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    @staticmethod
    def odd(c: Chunk) -> np.ndarray:
        """Texts with white space other than 0x20 and 0x09-0x0D."""
        d = c.data
        hit = (d >= 0x1C) & (d <= 0x1F)
        if len(d) > 2:
            a, b, e = d[:-2], d[1:-1], d[2:]
            hit[:-2] |= (a == 0xE2) & (b == 0x80) & ((e <= 0x8A) | (e == 0xA8) | (e == 0xA9) | (e == 0xAF))
            hit[:-2] |= ((a == 0xE1) & (b == 0x9A) & (e == 0x80)) | ((a == 0xE2) & (b == 0x81) & (e == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (e == 0x80))
        if len(d) > 1:
            hit[:-1] |= (d[:-1] == 0xC2) & ((d[1:] == 0xA0) | (d[1:] == 0x85))
        out = np.zeros(len(c.offsets) - 1, bool)
        out[np.searchsorted(c.offsets, np.flatnonzero(hit), side="right") - 1] = True
        return out

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts, each closed by END_ID; their lengths; positions after sentence ends."""
        starts, ends = self.spans(c)
        keys, first, inverse = np.unique(span_hashes(c, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.reset()
        keys = keys.tolist()
        got = [self.known.get(k) for k in keys]
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            where = first[missing]
            raw = c.data.tobytes()
            texts = [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())]
            word = ~_SPACE[c.data[ends[where] - 1]] & (ends[where] - starts[where] < 64)
            self.remember([keys[i] for i in missing], texts, word & ~self.odd(c)[np.searchsorted(c.offsets, starts[where], side="right") - 1])
            for i in missing:
                got[i] = self.known[keys[i]]
        place = np.array(got, dtype=np.int64)
        size = (place & 0xFFFFFFFF)[inverse]
        offset = (place >> 32)[inverse]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        doc_of_span = np.searchsorted(c.offsets, starts, side="right") - 1
        n_docs = len(c.offsets) - 1
        ids = np.full(total + n_docs, END_ID, dtype=np.uint32)
        ids[np.arange(total) + np.repeat(doc_of_span, size)] = self.arena[np.repeat(offset - (stop - size), size) + np.arange(total)]
        lengths = np.bincount(doc_of_span, weights=size, minlength=n_docs).astype(np.int64) + 1
        close = np.isin(c.data[ends - 1], np.frombuffer(b".!?\n", np.uint8)) if len(ends) else np.zeros(0, bool)
        return ids, lengths, (stop + doc_of_span)[close]


class Stream:
    """Open windows of one partition."""

    def __init__(self, length: int, part: int):
        self.length, self.sequence = length, part << 33
        self.ids = np.zeros(0, np.uint32)
        self.docs = np.zeros((0, 4), np.int64)  # doc id, whether it has one, ids already placed, ids in all
        self.pos, self.cost = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where cuts may fall, and what they cost

    def add(self, ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray, soft: np.ndarray) -> None:
        """soft: positions after sentence ends."""
        ends = np.cumsum(lengths)
        pos = np.concatenate(([0], ends, soft))
        cost = np.concatenate(([0], np.zeros(len(ends), np.int64), np.full(len(soft), SENTENCE_CUT)))
        order = np.lexsort((cost, pos))
        pos, cost = pos[order], cost[order]
        one = np.concatenate(([True], pos[1:] != pos[:-1]))
        pos, cost = pos[one], cost[one]
        long, step = min(LONG, self.length), min(INNER_STEP, self.length)
        far = np.flatnonzero(np.diff(pos) > long)
        if len(far):
            more = np.concatenate([np.arange(pos[i] + step, pos[i + 1], step) for i in far])
            pos, cost = np.concatenate((pos, more)), np.concatenate((cost, np.full(len(more), INNER_CUT)))
            order = np.argsort(pos, kind="stable")
            pos, cost = pos[order], cost[order]
        self.pos, self.cost = np.concatenate((self.pos, pos[1:] + len(self.ids))), np.concatenate((self.cost, cost[1:]))
        self.ids = np.concatenate((self.ids, ids))
        known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
        self.docs = np.concatenate((self.docs, np.stack((doc_ids.fill_null(0).to_numpy(zero_copy_only=False), known, np.zeros_like(lengths), lengths), 1)))

    def take(self, final: bool) -> pa.RecordBatch | None:
        """The pieces of all windows that later documents can't change; all of them if final."""
        if not len(self.ids):
            return None
        pos = [0, *self.pos.tolist()]
        back = best_backs(pos, [0, *self.cost.tolist()], self.length)
        windows = np.array([pos[i] for i in path(back, len(pos) - 1 if final else settled(pos, back, self.length))])
        done = int(windows[-1])
        if not done:
            return None
        left = self.docs[:, 3] - self.docs[:, 2]
        begin = np.cumsum(left) - left
        edges = np.union1d(windows, begin[begin < done])
        start, stop = edges[:-1], edges[1:]
        doc = np.searchsorted(begin, start, side="right") - 1
        window = np.searchsorted(windows, start, side="right") - 1
        raw = memoryview(self.ids.astype("<u4").view(np.uint8))
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist())]
        columns = [self.docs[doc, 2] + start - begin[doc], stop - start, crc, self.docs[doc, 3], self.sequence + window, start - windows[window]]
        doc_id = pa.array(self.docs[doc, 0], pa.int64(), mask=self.docs[doc, 1] == 0)
        out = pa.RecordBatch.from_arrays([doc_id, *[pa.array(x, pa.int64()) for x in columns]], names=[x.split()[0] for x in PIECES.split(", ")])
        self.sequence += len(windows) - 1
        self.ids = self.ids[done:].copy()
        later = self.pos > done
        self.pos, self.cost = self.pos[later] - done, self.cost[later]
        keep = begin + left > done
        self.docs[:, 2] += np.clip(done - begin, 0, left)
        self.docs = self.docs[keep]
        return out


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """PIECES: where each run of each document's ids lies. tokenizer: path of a tokenizers JSON file on every node."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        encoder, stream = Encoder(tokenizer), Stream(length, TaskContext.get().partitionId())
        for batch in batches:
            for c in chunks(batch.column(1), lower=False):
                ids, lengths, soft = encoder.encode(c)
                stream.add(ids, batch.column(0).slice(c.lo, c.hi - c.lo), lengths, soft)
                if (out := stream.take(False)) is not None:
                    yield out
        if (out := stream.take(True)) is not None:
            yield out
        del encoder, stream
        release()

    return df.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(place, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
