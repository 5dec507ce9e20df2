"""Near-duplicate documents by HyperMinHash: compressed min-hash registers, banding, corrected estimate, verification.

A document's word shingles are dealt over REGISTERS buckets by their hash; a bucket keeps the least of the rest of its
hashes as a leading-zero count and ten mantissa bits, 16 bits in all. An empty bucket borrows the register of another
bucket, in an order fixed for each bucket, so that any one register of two documents agrees with a chance equal to
their similarity, however short they are. Equal sets collapse to one representative before anything is compared.

Candidates are representatives that share a band of registers. In each of PHASES orders of leadership a document is
compared with one leader of its bands, estimated from registers with the chance collisions taken off and verified on
full shingle sets; links are contracted to components after each order, so a group of n gives n links an order at most.
Bands (of two documents or more) that still hold several components are then compared across components: small bands as pairs, others in blocks of
bounded memory that verify where they compare, skip what is joined and give links that join components only. That last
step is quadratic in the members of a band that are alike in size and bands but not linked; links within a group never
are. Components come from min-label steps over written tables. No link between different sets is lost but by all BANDS
bands missing it (below 1e-6 at the threshold), or by an estimate MARGIN too low.

Defined edge cases: a null or empty text, or one without words, has no shingles and is linked with nothing; a text
with fewer words than a shingle is one shingle; rows that repeat an id are one document, which the row of least digest
stands for (each row has its own n_shingles, all the same component); a row with a null id is linked with nothing and
has a null component; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType

from .ids import id_filter, split_rows
from .tables import discard, fresh, table, written, written_count
from .text import U64, chunks, mix, shingles

REGISTERS, BAND = 288, 6
BANDS = REGISTERS // BAND
MANTISSA = 10
#: Similarity of linked sets, in hundredths.
PERCENT = 80
#: Estimates this far below the threshold are still verified: over five standard errors of REGISTERS registers.
MARGIN = 0.13
#: Orders of leadership in bands; bands compared as pairs; documents compared with each other in one block (on average:
#: blocks are hash parts).
PHASES, SMALL, BLOCK = 3, 16, 1024

_rank = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=U64) + U64(12345)).reshape(REGISTERS, REGISTERS), 1)
#: _rank[i, t]: the bucket that bucket i borrows from at its t-th try, itself first.
_rank = np.stack([np.concatenate(([i], r[r != i])) for i, r in enumerate(_rank)])


def registers(h: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a set of 64-bit hashes, not empty."""
    bucket = ((h >> U64(32)) * U64(REGISTERS)) >> U64(32)
    rest = mix(h + U64(0x632BE59BD9B4E019))
    order = np.lexsort((rest, bucket))
    b = bucket[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    value = rest[order][first]
    zeros = np.minimum(63 - np.floor(np.log2(np.maximum(value, 1).astype(np.float64))).astype(np.int64).clip(0, 63), 62)
    mantissa = (value << (zeros + 1).astype(U64)) >> U64(64 - MANTISSA)
    out = np.zeros(REGISTERS, np.uint16)
    out[b[first]] = (zeros.astype(np.uint16) + 1) << MANTISSA | mantissa.astype(np.uint16)
    full = out > 0
    todo = np.flatnonzero(~full)
    t = 1
    filled = out.copy()
    while len(todo):
        source = _rank[todo, t]
        ok = full[source]
        filled[todo[ok]] = out[source[ok]]
        todo, t = todo[~ok], t + 1
    return filled


def collision_rate(n: float, m: float) -> float:
    """Chance that two different minima of n and m hashes share a register: same zeros, same mantissa bits.

    A bucket with x hashes on average has minima near 1 / x; a register cell holds a share 2 ** -(MANTISSA + 1) of
    that scale, up to a constant close to one.
    """
    x, y = max(n / REGISTERS, 1.0), max(m / REGISTERS, 1.0)
    total = 0.0
    for z in range(1, 40):  # minima in [2 ** -z, 2 ** (1 - z)), cells of equal width
        lo, hi = 2.0**-z, 2.0 ** (1 - z)
        total += ((1 - lo) ** x - (1 - hi) ** x) * ((1 - lo) ** y - (1 - hi) ** y) / 2**MANTISSA
    return total


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of each pair of rows of registers, chance collisions taken off; n, m: set sizes."""
    same = (a == b).mean(1)
    chance = np.array([collision_rate(x, y) for x, y in zip(n, m)])
    return np.clip((same - chance) / (1 - chance), 0, 1)


def digest(own: np.ndarray) -> bytes | None:
    """128 bits that stand for a set of hashes; none for the empty one."""
    return mix(np.array([own.sum(dtype=U64), mix(own).sum(dtype=U64)]) + U64(len(own))).tobytes() if len(own) else None


def sketched(df: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, digest (of the set) and registers of each row; null digest and registers without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for c in chunks(batch.column(1)):
                h, offsets = shingles(c.hashes, c.words, words)
                sizes, digests, regs = [], [], []
                for i in range(c.hi - c.lo):
                    own = np.unique(h[offsets[i] : offsets[i + 1]])
                    sizes.append(len(own))
                    digests.append(digest(own))
                    regs.append(registers(own).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n_shingles", "digest", "registers"])

    slim = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(run, "id long, n_shingles long, digest binary, registers binary")


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, n, registers and hashes (sorted, distinct shingle hashes) of the rows of docs (id, t) with the given ids,
    written. Where rows repeat an id, the set of the least digest stands for it."""
    found = id_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            batch = batch.filter(pa.array(found.hits(batch.column(0))))
            for c in chunks(batch.column(1)):
                h, offsets = shingles(c.hashes, c.words, words)
                sets = [np.unique(h[offsets[i] : offsets[i + 1]]) for i in range(c.hi - c.lo)]
                regs = [registers(x).tobytes() if len(x) else None for x in sets]
                columns = [batch.column(0).slice(c.lo, c.hi - c.lo), pa.array([digest(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(regs, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "n", "registers", "hashes"])

    got = docs.select("id", "t").mapInArrow(run, "id long, digest binary, n long, registers binary, hashes binary").filter("digest is not null")
    least = got.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("digest", "n", "registers", "hashes")).alias("r"))
    return written(least.select("id", "r.n", "r.registers", "r.hashes"), "shingle-sets")


@F.pandas_udf(BooleanType())
def _likely(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), REGISTERS)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), REGISTERS)
    return pd.Series(estimate(x, y, n.to_numpy(), m.to_numpy()) >= PERCENT / 100 - MARGIN)


@F.pandas_udf(BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked; pairs: distinct, sets: those of their ids."""
    side = lambda x, *cols: sets.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    near = pairs.join(side("a", "n", "registers"), "a").join(side("b", "n", "registers"), "b").filter(_likely("registers_a", "registers_b", "n_a", "n_b"))
    near = written(near.select("a", "b"), "near-pairs")
    return near.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b").filter(_linked("hashes_a", "hashes_b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """id, component (its least reachable id) of every id in links (a, b): each round, a node takes the least label
    among its neighbours' and then its label's label; rounds go on until no label changes."""
    both, n = written_count(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, last = both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), None
    while n:
        known = labels.select(F.col("id").alias("b"), "component")
        near = both.join(known, "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        stepped = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        after = stepped.join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("cc", "c")).alias("component"))
        after, n = written_count(after, "labels", F.col("component") != F.col("old"))
        if last is not None:
            discard(last)
        labels, last = after.select("id", "component"), after
    return labels


def _joining_links(rows: DataFrame) -> DataFrame:
    """Verified links (a, b) that join components, block by block.

    rows: k and band, blocks i and j, id, component, own block, n, registers, hashes. A pair is compared in the first
    band that it shares only, and no more once its components are joined.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group["registers"]), np.uint16).reshape(len(group), BANDS, BAND)
        sets = [np.frombuffer(h, U64) for h in group["hashes"]]
        ids, comp, size, block = (group[c].to_numpy() for c in ("id", "component", "n", "own"))
        names, root = np.unique(comp, return_inverse=True)
        band, i, j = (group[c].iloc[0] for c in ("k", "i", "j"))
        links = []
        for k in np.flatnonzero(block == i):
            open_ = (root != root[k]) & (block == j) & (100 * size >= PERCENT * size[k]) & (100 * size[k] >= PERCENT * size)
            if i == j:
                open_[: k + 1] = False
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            same = x[at] == x[k]
            at = at[(same.reshape(len(at), -1).mean(1) >= PERCENT / 100 - MARGIN) & (same.all(2).argmax(1) == band)]
            for lo in range(0, len(at), 64):
                part = at[lo : lo + 64]
                part = part[root[part] != root[k]]
                if not len(part):
                    continue
                others = np.concatenate([sets[m] for m in part])
                where = np.minimum(np.searchsorted(sets[k], others), len(sets[k]) - 1)
                lengths = size[part]
                both = np.add.reduceat((sets[k][where] == others).astype(np.int64), np.cumsum(lengths) - lengths)
                for m in part[100 * both >= PERCENT * (lengths + size[k] - both)]:
                    if root[m] != root[k]:
                        links.append((max(ids[k], ids[m]), min(ids[k], ids[m])))
                        root[root == root[m]] = root[k]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return rows.groupBy("k", "band", "i", "j").applyInPandas(run, "a long, b long")


def _leader_links(shared: DataFrame, sets: DataFrame, labels: DataFrame, phases: int) -> DataFrame:
    """Components (id, component) after some orders of leaders over shared (band, id, n).

    In each order, a document is compared with one leader, that of most of its bands; bands whose members are all in
    one component drop out. So an order adds one link a document at most, and components, not links, are carried on.
    """
    tested = None
    for phase in range(phases):
        order = F.xxhash64(F.lit(phase), "id")
        placed = shared.join(labels, "id")
        lead = placed.groupBy("band").agg(F.min(F.struct(order.alias("o"), "id", "n", "component")).alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        fits = (100 * F.col("n") >= PERCENT * F.col("lead.n")) & (100 * F.col("lead.n") >= PERCENT * F.col("n"))
        met = placed.join(lead, "band").filter(fits & (F.col("component") != F.col("lead.component")))
        met = met.groupBy("id", F.col("lead.id").alias("leader")).agg(F.count(F.lit(1)).alias("times"))
        if tested is not None:
            met = met.join(tested, ["id", "leader"], "left_anti")
        best = F.max(F.struct("times", F.xxhash64(F.lit(phase), "leader").alias("o"), "leader")).alias("m")
        pairs, n = written_count(met.groupBy("id").agg(best).select(F.col("id").alias("a"), F.col("m.leader").alias("b")), "pairs")
        if not n:
            return labels
        # A pair is not met again in either direction.
        both = pairs.select(F.col("a").alias("id"), F.col("b").alias("leader")).union(pairs.select(F.col("b").alias("id"), F.col("a").alias("leader")))
        tested = both if tested is None else tested.union(both)
        labels = relabelled(labels, _verified(pairs, sets))
    return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after links (a, b) between ids: only links that join components are followed."""
    x, y = labels.select(F.col("id").alias("a"), F.col("component").alias("x")), labels.select(F.col("id").alias("b"), F.col("component").alias("y"))
    merged = components(links.join(x, "a").join(y, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    merged = merged.select(F.col("id").alias("component"), F.col("component").alias("now"))
    return written(labels.join(merged, "component", "left").select("id", F.coalesce("now", "component").alias("component")), "labels")


def near_duplicates(df: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (least linked key) of every row; 80 of 100 shingles in common link two."""
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t"))
    all_rows = written(sketched(docs, words, "id", "t"), "sketches")
    full = all_rows.filter("id is not null and digest is not null")
    of_id = full.groupBy("id").agg(F.min("digest").alias("digest"))
    rep = of_id.groupBy("digest").agg(F.min("id").alias("rep"))
    members = written(of_id.join(rep, "digest").select("id", "rep"), "members")
    sketches = full.groupBy("digest").agg(F.min(F.struct("n_shingles", "registers")).alias("r")).join(rep, "digest")
    sketches = written(sketches.select(F.col("rep").alias("id"), F.col("r.n_shingles").alias("n"), "r.registers"), "representatives")

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("k"), F.xxhash64(i, F.substring("registers", i * 2 * BAND + 1, F.lit(2 * BAND))).alias("band"))))
    banded = sketches.select("id", "n", band.alias("s")).select("id", "n", "s.k", "s.band")
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(banded.join(sizes, "band").select("k", "band", "id", "n", "size"), "shared-bands")
    wanted = written(shared.select("id").distinct(), "wanted")
    sets = sets_of(docs, wanted, words)
    labels = _leader_links(shared.select("band", "id", "n"), sets, wanted.select("id", F.col("id").alias("component")), PHASES)

    # What bands still hold in more than one component.
    placed = shared.join(labels, "id")
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
    open_bands = written(placed.join(mixed, "band"), "open-bands")
    small = open_bands.filter(F.col("size") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    fits = (100 * F.col("x.n") >= PERCENT * F.col("y.n")) & (100 * F.col("y.n") >= PERCENT * F.col("x.n"))
    few = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.component") < F.col("y.component")) & fits).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))
    few = written(few.distinct(), "rest-pairs")
    many = open_bands.filter(F.col("size") > SMALL)
    many = many.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))))
    dealt = many.withColumn("m", met).select("k", "band", "id", "component", "own", "m.i", "m.j").join(sets, "id")
    labels = relabelled(labels, _verified(few, sets).union(_joining_links(dealt)))

    placed = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = all_rows.select("id", "n_shingles").join(placed, "id", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def without_near_duplicates(df: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stand for their group (least key), with all their columns; rows without a key all stay.

    Of rows that repeat a key, the one of least text stays (ties: the least as JSON).
    """
    found = near_duplicates(df, words, key, text)
    found = written(found.select(F.col(key).alias("id"), "component_id").filter("id is not null"), "groups")
    gone = found.filter("id <> component_id").select("id").distinct()
    twice = found.groupBy("id").count().filter("count > 1").select("id")
    clear, rest = split_rows(df, written(gone.union(twice).distinct(), "suspects"), key)
    name = fresh(df, "_id")
    rest = rest.withColumn(name, F.col(key).cast("bigint"))
    rest = rest.join(gone.toDF(name), name, "left_anti").join(twice.toDF(name).withColumn(fresh(df, "_twice"), F.lit(True)), name, "left")
    again = F.col(fresh(df, "_twice")).isNotNull()
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = rest.filter(again).groupBy(name).agg(F.min_by(row, F.struct(F.col(text).cast("string"), F.to_json(row))).alias("r"))
    return clear.unionByName(rest.filter(~again).select(*df.columns)).unionByName(one.select("r.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], chr(10)) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), links AS (
  SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s WHERE a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * i >= 80 * (a.n + b.n - i)
), reach AS (
  SELECT doc_id AS s, doc_id AS r FROM documents UNION SELECT reach.s, links.y FROM reach JOIN links ON links.x = reach.r
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r) AS component_id, w.doc_id = min(r) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.s = w.doc_id GROUP BY w.doc_id, n.n
"""
