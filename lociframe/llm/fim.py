"""Fill-in-middle transformation: texts cut at two units of their own and rearranged as prefix, suffix, middle.

A unit is a run of letters A-Z, a-z or any other single code point. Each text is laid out in blocks of BLOCK bytes; a
Fenwick tree over its blocks stores units and code points. A cut after k units is found by binary-lifting descent to the
block in which unit k begins, whose prefix of code points comes with the descent; only that block is then looked at. The
trees of all texts of a chunk are built and descended together, so memory follows the chunk, or one single text.

Which cuts, and which form, follow from the SHA-256 of the seed and the key alone, so that rows come out alike on any
partitioning, and when a task is run again.

Defined edge cases: a null or empty text, and one that holds a marker, stays plain (null gives the empty text); a null key
is hashed as an empty one; a cut may be at either end, so parts may be empty; repeated rows give equal rows; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import table
from .text import Chunk, raw_chunks

#: Bytes of a block.
BLOCK = 1024
#: Fixed values of the transformation: markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many are rearranged, and how many of these have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Forest:
    """Fenwick trees over the blocks of the texts of a chunk, of units and of code points; text i has size[i] blocks, node j
    (from 1) of its tree is at base[i] + j."""

    def __init__(self, c: Chunk):
        self.chunk = c
        data, offsets = c.data, c.offsets
        letter = _LETTER[data]
        self.lead = (data & 0xC0) != 0x80
        again = np.zeros(len(data), bool)
        again[1:] = letter[1:] & letter[:-1]
        starts = offsets[:-1][offsets[:-1] < len(data)]
        again[starts] = False
        self.begin = self.lead & ~again
        length = np.diff(offsets)
        self.size = -(-length // BLOCK)
        self.base = np.concatenate(([0], np.cumsum(self.size + 1)))[:-1]
        text = np.repeat(np.arange(len(length)), self.size)
        within = np.arange(len(text)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        at = offsets[text] + within * BLOCK
        self.tree = np.zeros((int((self.size + 1).sum()), 2), np.int64)
        if len(at):
            plain = np.stack([np.add.reduceat(self.begin, at, dtype=np.int64), np.add.reduceat(self.lead, at, dtype=np.int64)], 1)
            node = within + 1
            # Node j holds the blocks j - lowbit(j) + 1 to j: a difference of running sums.
            total = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(plain, 0)))
            last = np.arange(len(at)) + 1
            self.tree[self.base[text] + node] = total[last] - total[last - (node & -node)]

    def totals(self) -> np.ndarray:
        """Units and code points of each text, by the nodes on the way up from its last block."""
        out = np.zeros((len(self.size), 2), np.int64)
        node = self.size.copy()
        while node.any():
            out += np.where((node > 0)[:, None], self.tree[self.base + node], 0)
            node -= node & -node
        return out

    def cuts(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset and code points before the cut after k[i] units (at most all) of each text i."""
        size, n = self.size, len(self.size)
        node, before = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
        step = 1 << int(size.max(initial=0)).bit_length()
        while step:
            to = node + step
            inside = to <= size
            more = self.tree[self.base + np.where(inside, to, 0)]
            # As many whole blocks as hold at most k units: unit k then begins in the next one.
            go = inside & (before[:, 0] + more[:, 0] <= k)
            node, before = np.where(go, to, node), before + np.where(go[:, None], more, 0)
            step >>= 1
        length = np.diff(self.chunk.offsets)
        at, chars = np.minimum(node * BLOCK, length), before[:, 1].copy()
        local = np.flatnonzero(node < size)
        for part in np.array_split(local, max(1, len(local) // 512)):
            place = self.chunk.offsets[part, None] + at[part, None] + np.arange(BLOCK)
            end = self.chunk.offsets[part + 1, None]
            safe = np.minimum(place, end - 1)
            begun = np.cumsum(self.begin[safe] & (place < end), 1)
            found = (begun > (k[part] - before[part, 0])[:, None]).argmax(1)
            points = np.cumsum(self.lead[safe] & (place < end), 1)
            chars[part] += np.where(found > 0, points[np.arange(len(part)), found - 1], 0)
            at[part] += found
        return at, chars


def _drawn(key: str, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of each key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, the text to train on."""
    slim = df.select(F.col(key).alias("key"), *_drawn(key, seed), F.col(text).cast("string").alias("t"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    kind = slim.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
            for c in raw_chunks(batch.column(5)):
                h1, h2, h3, h4 = (h[c.lo : c.hi] for h in drawn)
                forest = Forest(c)
                n = forest.totals()[:, 0]
                a, b = h1 % (n + 1), h2 % (n + 1)
                (first, chars), (second, upto) = forest.cuts(np.minimum(a, b)), forest.cuts(np.maximum(a, b))
                out, form = [], []
                for i in range(c.hi - c.lo):
                    whole = c.data[c.offsets[i] : c.offsets[i + 1]].tobytes()
                    if not whole or h3[i] % 100 >= rate or any(x in whole for x in marks):
                        out.append(whole)
                        form.append("plain")
                        continue
                    prefix, middle, suffix = whole[: first[i]], whole[first[i] : second[i]], whole[second[i] :]
                    spm = h4[i] % 100 < suffix_first
                    out.append(s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle)
                    form.append("spm" if spm else "psm")
                plain = np.array([f == "plain" for f in form], bool)
                columns = [batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(n), pa.array(form, pa.string()), pa.array(chars, mask=plain), pa.array(upto - chars, mask=plain)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary()).cast(pa.string())], names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    return slim.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", key)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone.

    Texts with a marker stay plain, and no marker ends as another begins, so an output splits in just one way.
    """
    part = F.split(F.col(output), "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return (
        F.when(F.col(form) == "psm", F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2)))
        .when(F.col(form) == "spm", F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1)))
        .otherwise(F.col(output))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]', 0, 's') AS u
  FROM documents
), c AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR regexp_matches(t, '<P>|<S>|<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(u[1 : least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1 : n], '') AS suf
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM p
"""
