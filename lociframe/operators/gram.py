"""Additive moments of packed genotypes, by family and tile of markers, and relationship matrices.

With X the dosages (missing as 0) and O the observed flags, a tile (i, j) holds A = X_i'X_j, B = O_i'X_j, B' = X_i'O_j
and C = O_i'O_j; a vector row holds X'y, O'y, X'1 and O'1, n, sum y and sum y^2. All are sums over samples, so any training
set's moments are those of all families less the families left out, from one pass over the genotypes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .encode import MISSING

TILE = 512
#: Parts that rows are dealt over; bytes of dosages decoded at a time; bytes of sums that a task holds.
PARTS, DECODED, LIMIT = 64, 1 << 22, 64 << 20
MOMENTS = "family_id string, ti int, tj int, payload binary"


def decoded(dosages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """X (missing as 0) and O of packed rows."""
    raw = np.frombuffer(b"".join(dosages), np.int8).reshape(len(dosages), -1)
    seen = raw != MISSING
    return np.where(seen, raw, 0).astype(np.float64), seen.astype(np.float64)


def family_gram(geno: DataFrame, tile: int = TILE, salts: int = 8) -> DataFrame:
    """MOMENTS of packed rows (family_id, dosages, yield). A family is dealt over `salts` tasks and summed after."""
    dealt = geno.select(F.col("family_id").cast("string").alias("family_id"), "dosages", F.col("yield").cast("double").alias("y"))
    dealt = dealt.repartition("family_id", F.pmod(F.xxhash64("dosages"), F.lit(salts))).sortWithinPartitions("family_id")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}
        for batch in batches:
            families, y_all = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            rows = batch.column(1).to_pylist()
            edges = [0, *[i for i in range(1, len(rows)) if families[i] != families[i - 1]], len(rows)]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                if families[s] != now:
                    if now is not None:
                        yield emit(now, sums)
                    now, sums = families[s], {}
                for lo in range(s, e, 2000):
                    add(sums, *decoded(rows[lo : min(lo + 2000, e)]), y_all[lo : min(lo + 2000, e)])
        if now is not None:
            yield emit(now, sums)

    def add(sums: dict, x: np.ndarray, o: np.ndarray, y: np.ndarray) -> None:
        m = x.shape[1]
        v = np.concatenate((x.T @ y, o.T @ y, x.sum(0), o.sum(0), [len(y), y.sum(), (y * y).sum()]))
        sums[-1, -1] = sums.get((-1, -1), 0) + v
        for i in range(0, m, tile):
            for j in range(i, m, tile):
                a, b = slice(i, i + tile), slice(j, j + tile)
                t = np.stack((x[:, a].T @ x[:, b], o[:, a].T @ x[:, b], x[:, a].T @ o[:, b], o[:, a].T @ o[:, b]))
                sums[i // tile, j // tile] = sums.get((i // tile, j // tile), 0) + t

    def emit(family: str, sums: dict) -> pa.RecordBatch:
        keys = sorted(sums)
        return pa.RecordBatch.from_arrays(
            [pa.array([family] * len(keys)), pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([np.ascontiguousarray(sums[k]).tobytes() for k in keys], pa.binary())],
            names=["family_id", "ti", "tj", "payload"],
        )

    def total(group: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(p) for p in group["payload"])
        return pd.DataFrame({"family_id": group["family_id"].iloc[:1], "ti": group["ti"].iloc[:1], "tj": group["tj"].iloc[:1], "payload": [s.tobytes()]})

    return dealt.mapInArrow(partial, MOMENTS).groupBy("family_id", "ti", "tj").applyInPandas(total, MOMENTS)


def training_moments(moments: DataFrame, folds: DataFrame) -> DataFrame:
    """held_out_family, stage, ti, tj, payload for each fold: stage final (all but the held-out family), and with a
    validation_family in folds also selection (without that family too) and validation (that family alone)."""
    with_validation = "validation_family" in folds.columns
    rows = folds.select("held_out_family", "validation_family" if with_validation else F.lit(None).cast("string").alias("validation_family"))
    plan = [(r[0], r[1]) for r in rows.collect()]  # a row for each family

    def split(group: pd.DataFrame) -> pd.DataFrame:
        by = {f: np.frombuffer(p) for f, p in zip(group["family_id"], group["payload"])}
        every, zero = sum(by.values()), np.zeros_like(next(iter(by.values())))
        out = []
        for held, validation in plan:
            final = every - by.get(held, zero)
            out.append((held, "final", final.tobytes()))
            if validation is not None:
                own = by.get(validation, zero)
                out += [(held, "selection", (final - own).tobytes()), (held, "validation", own.tobytes())]
        done = pd.DataFrame(out, columns=["held_out_family", "stage", "payload"])
        return done.assign(ti=group["ti"].iloc[0], tj=group["tj"].iloc[0])[["held_out_family", "stage", "ti", "tj", "payload"]]

    return moments.groupBy("ti", "tj").applyInPandas(split, "held_out_family string, stage string, ti int, tj int, payload binary")


class Moments:
    """The moments of one training set, put together from its tiles."""

    def __init__(self, rows: pd.DataFrame):
        v = np.frombuffer(rows["payload"][rows["ti"] < 0].iloc[0])
        m = (len(v) - 3) // 4
        self.m = m
        self.xy, self.oy, self.sx, self.so = v[:m], v[m : 2 * m], v[2 * m : 3 * m], v[3 * m : 4 * m]
        self.n, self.sy, self.syy = v[4 * m :]
        self.a, self.b, self.c = np.zeros((m, m)), np.zeros((m, m)), np.zeros((m, m))
        tiles = rows[rows["ti"] >= 0]
        last = int(tiles["ti"].max())
        tile = m if last == 0 else next(int(np.sqrt(len(p) / 32)) for i, j, p in zip(tiles["ti"], tiles["tj"], tiles["payload"]) if i == j == 0)
        for i, j, p in zip(tiles["ti"], tiles["tj"], tiles["payload"]):
            r, s = slice(i * tile, min((i + 1) * tile, m)), slice(j * tile, min((j + 1) * tile, m))
            a, b, b2, c = np.frombuffer(p).reshape(4, r.stop - r.start, s.stop - s.start)
            self.a[r, s], self.b[r, s], self.c[r, s] = a, b, c
            if i != j:
                self.a[s, r], self.b[s, r], self.c[s, r] = a.T, b2.T, c.T

    def statistics(self) -> dict[str, np.ndarray]:
        """observed_rate, mean, variance, p and maf of each marker, as markers.with_statistics."""
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(self.so > 0, self.sx / self.so, np.nan)
            variance = (np.diag(self.a) - self.so * np.nan_to_num(mean) ** 2) / self.n
        p = (mean + 1) / 2
        return {"observed_rate": self.so / self.n, "mean": mean, "variance": variance, "allele_freq": p, "maf": np.minimum(p, 1 - p)}

    def centred(self, mean: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Z'Z, Z'y and Z'1 of the kept markers' columns, imputed and centred with the given means."""
        mu = mean[keep]
        b = self.b[np.ix_(keep, keep)]
        g = self.a[np.ix_(keep, keep)] - mu[:, None] * b - (mu[:, None] * b).T + np.outer(mu, mu) * self.c[np.ix_(keep, keep)]
        return g, self.xy[keep] - mu * self.oy[keep], self.sx[keep] - mu * self.so[keep]


def relationship(z: DataFrame, denominator: DataFrame, jitter: float = 0.0) -> DataFrame:
    """fold, sample_i, sample_j, value over a long table of imputed, centred dosages (fold, sample_id, marker_pos, z).

    A self-join on (fold, marker): for small panels and as the reference form; prediction never needs it.
    """
    a, b = z.select("fold", "marker_pos", F.col("sample_id").alias("sample_i"), F.col("z").alias("zi")), z.select("fold", "marker_pos", F.col("sample_id").alias("sample_j"), F.col("z").alias("zj"))
    sums = a.join(b, ["fold", "marker_pos"]).groupBy("fold", "sample_i", "sample_j").agg(F.sum(F.col("zi") * F.col("zj")).alias("s"))
    value = F.col("s") / F.col("denominator") + F.when(F.col("sample_i") == F.col("sample_j"), jitter).otherwise(0.0)
    return sums.join(F.broadcast(denominator), "fold").select("fold", "sample_i", "sample_j", value.alias("value"))


def relationship_blocks(left: DataFrame, right: DataFrame, mean: np.ndarray, keep: np.ndarray, denominator: float, block: int = 1024, jitter: float = 0.0) -> DataFrame:
    """Upper-level form for one training set: left x right samples in blocks multiplied by numpy.

    left, right: sample_pos and dosages. With jitter (training matrix), it is added where positions are equal.
    """
    side = lambda df, n: df.select(F.floor(F.col("sample_pos") / block).cast("int").alias(f"b{n}"), F.col("sample_pos").alias(f"p{n}"), F.col("dosages").alias(f"d{n}"))
    pack = lambda df, n: df.groupBy(f"b{n}").agg(F.array_sort(F.collect_list(F.struct(f"p{n}", f"d{n}"))).alias(f"v{n}"))
    a, b = pack(side(left, 1), 1), pack(side(right, 2), 2)
    pairs = a.join(b, F.lit(True))  # every block with every block: the output has a cell for every pair of samples

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for v1, v2 in zip(pdf["v1"], pdf["v2"]):
                sides = []
                for v, n in ((v1, 1), (v2, 2)):
                    x, o = decoded([r[f"d{n}"] for r in v])
                    sides.append((np.array([r[f"p{n}"] for r in v]), ((x - o * mean)[:, keep])))
                (pi, zi), (pj, zj) = sides
                k = zi @ zj.T / denominator + jitter * (pi[:, None] == pj[None])
                yield pd.DataFrame({"sample_i": np.repeat(pi, len(pj)), "sample_j": np.tile(pj, len(pi)), "value": k.ravel()})

    return pairs.mapInPandas(multiply, "sample_i long, sample_j long, value double")


def packed_statistics(stats: DataFrame, *more: str) -> DataFrame:
    """fold, denominator, means and retained (doubles and flags of all markers, as bytes) of training statistics
    (held_out_family, marker_pos, mean, allele_freq, retained), and columns of more doubles. A fold's rows are as many as
    there are markers."""
    p = F.col("allele_freq")
    doubles = ["mean", *more]
    row = F.struct("marker_pos", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in doubles], "retained")
    got = stats.groupBy(F.col("held_out_family").cast("string").alias("fold")).agg(F.sum(F.when(F.col("retained"), 2 * p * (1 - p))).alias("denominator"), F.array_sort(F.collect_list(row)).alias("s"))
    got = got.select("fold", "denominator", F.col("s.retained").alias("retained"), *[F.col(f"s.{c}").alias(c) for c in doubles])
    names = ["fold", "denominator", "retained", "means", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.asarray(x.values.cast(pa.uint8())).tobytes() for x in batch.column(2)]
            values = [[np.asarray(x.values, float).tobytes() for x in c] for c in batch.columns[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.binary()) for x in (kept, *values)]], names=names)

    return got.mapInArrow(run, "fold string, denominator double, " + ", ".join(f"{c} binary" for c in names[2:]))


def fold_relationships(geno: DataFrame, stats: DataFrame, part: str, jitter: float = 0.0, block: int = 512) -> DataFrame:
    """fold, sample_i, sample_j, value of every fold, under its training statistics (held_out_family, marker_pos, mean,
    allele_freq, retained): part "train" is training x training samples, "test" held-out x training, "own" held-out x
    held-out. geno: family_id, sample_pos, dosages.

    One schedule for all folds: samples stand in blocks, each unordered pair of blocks goes to one task, which decodes it
    once, multiplies it for every fold and gives both halves. With training statistics that differ by fold, and missing
    calls, there is no common product to correct, so a fold is a product of its own. The statistics, (families x markers)
    numbers, go to a task beside each pair of blocks; nothing is collected.
    """
    if part not in ("train", "test", "own"):
        raise ValueError(part)
    placed = geno.select(F.floor(F.col("sample_pos") / block).cast("int").alias("b"), F.struct("sample_pos", F.col("family_id").cast("string").alias("family_id"), "dosages").alias("v"))
    packed = placed.groupBy("b").agg(F.array_sort(F.collect_list("v")).alias("v"))  # at most `block` rows each
    one, two = packed.toDF("b1", "v1"), packed.toDF("b2", "v2")
    pairs = one.join(two, F.col("b1") <= F.col("b2"))
    every = packed_statistics(stats).agg(F.collect_list(F.struct("fold", "denominator", "means", "retained")).alias("folds"))  # a row for each family
    work = pairs.join(every, F.lit(True)).select("b1", "v1", "b2", "v2", "folds")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b1, v1, b2, v2, every in pdf.itertuples(index=False):
                (pi, fi, xi, oi), (pj, fj, xj, oj) = [(np.array([r["sample_pos"] for r in v]), np.array([r["family_id"] for r in v]), *decoded([r["dosages"] for r in v])) for v in (v1, v2)]
                for r in every:
                    fold, keep = r["fold"], np.frombuffer(r["retained"], bool)
                    mean = np.frombuffer(r["means"])[keep]
                    k = (xi[:, keep] - oi[:, keep] * mean) @ (xj[:, keep] - oj[:, keep] * mean).T / (r["denominator"] or np.nan)
                    if part != "test":
                        k += jitter * (pi[:, None] == pj[None])
                    for p, f, q, g, value in ((pi, fi, pj, fj, k), *([(pj, fj, pi, fi, k.T)] if b1 != b2 else [])):
                        left, right = {"train": (f != fold, g != fold), "test": (f == fold, g != fold), "own": (f == fold, g == fold)}[part]
                        if left.any() and right.any():
                            i, j = p[left], q[right]
                            yield pd.DataFrame({"fold": fold, "sample_i": np.repeat(i, len(j)), "sample_j": np.tile(j, len(i)), "value": value[np.ix_(left, right)].ravel()})

    return work.mapInPandas(multiply, "fold string, sample_i long, sample_j long, value double")


def weighted_sums(geno: DataFrame) -> DataFrame:
    """family_id, marker_pos, wx, wo, n: sums of weight times dosage and of weight over the observed calls of a marker, and
    the family's samples. geno: family_id, dosages, weight. A task sends when its families take LIMIT bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for family, (wx, wo, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([family] * len(wx)), pa.array(np.arange(len(wx))), pa.array(wx), pa.array(wo), pa.array(n.astype(np.int64))], names=["family_id", "marker_pos", "wx", "wo", "n"])
            sums.clear()

        for batch in batches:
            families, rows, weight = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            step = max(1, DECODED // max(len(rows[0]), 1)) if rows else 1
            for lo in range(0, len(rows), step):
                x, o = decoded(rows[lo : lo + step])
                f, w = families[lo : lo + step], weight[lo : lo + step]
                for family in np.unique(f):
                    own = f == family
                    sums[family] = sums.get(family, 0) + np.stack((w[own] @ x[own], w[own] @ o[own], np.full(x.shape[1], own.sum())))
                if sum(s.nbytes for s in sums.values()) > LIMIT:
                    yield from sent()
        yield from sent()

    parts = geno.select(F.col("family_id").cast("string").alias("family_id"), "dosages", F.col("weight").cast("double").alias("weight"))
    parts = parts.mapInArrow(run, "family_id string, marker_pos long, wx double, wo double, n long")
    return parts.groupBy("family_id", "marker_pos").agg(*[F.sum(c).alias(c) for c in ("wx", "wo", "n")])


def relationship_sums(geno: DataFrame, stats: DataFrame, part: str, jitter: float = 0.0, parts: int = PARTS) -> DataFrame:
    """fold, sample_i, n, row_sum, diagonal of the matrices that fold_relationships gives (part and stats as there): the cells
    of a sample's row, their sum weighted by the columns' weights, and the cell on the diagonal (null for "test").

    geno: family_id, sample_id, dosages, weight. With Z the imputed, centred dosages, a row of ZZ' times the weights w is z_i
    times Z'w, so no cell is made: one pass adds Z'w up by family, which gives it for every fold (own, or all but own), and
    one multiplies each row by it. Work and rows grow with the samples. The folds' vectors, (families x markers) numbers,
    go before the rows of each of `parts` parts, and rows stream by.
    """
    if part not in ("train", "test", "own"):
        raise ValueError(part)
    sums = weighted_sums(geno).withColumnRenamed("family_id", "held_out_family")
    if part != "own":
        total = sums.groupBy("marker_pos").agg(*[F.sum(c).alias(f"t_{c}") for c in ("wx", "wo", "n")])
        every = stats.select(F.col("held_out_family").cast("string").alias("held_out_family"), "marker_pos").join(sums, ["held_out_family", "marker_pos"], "left").join(total, "marker_pos")
        sums = every.select("held_out_family", "marker_pos", *[(F.col(f"t_{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("wx", "wo", "n")])
    columns = stats.withColumn("held_out_family", F.col("held_out_family").cast("string")).join(sums, ["held_out_family", "marker_pos"], "left")
    columns = columns.withColumn("sums", F.col("wx") - F.coalesce("mean", F.lit(0.0)) * F.col("wo"))
    sizes = sums.groupBy(F.col("held_out_family").alias("fold")).agg(F.max("n").alias("n"))
    folds = packed_statistics(columns, "sums").join(sizes, "fold").filter("n > 0")
    none = lambda kind: F.lit(None).cast(kind)
    before = folds.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "fold", none("string").alias("sample"), "n", F.col("denominator").alias("v"), F.col("means").alias("a"), "retained", "sums")
    rows = geno.select(
        F.pmod(F.xxhash64("sample_id", "dosages"), F.lit(parts)).cast("int").alias("part"), F.col("family_id").cast("string").alias("fold"), F.col("sample_id").cast("string").alias("sample"), none("long").alias("n"),
        F.col("weight").cast("double").alias("v"), F.col("dosages").alias("a"), none("binary").alias("retained"), none("binary").alias("sums"),
    )
    both = before.unionByName(rows).repartition("part").sortWithinPartitions("part", F.asc_nulls_last("n"))

    def answered(ready: tuple, families: list[str], samples: list[str], weights: list[float], dosages: list[bytes]) -> Iterator[pa.RecordBatch]:
        folds, n, denominator, mean, keep, s = ready
        step = max(1, DECODED // max(len(dosages[0]), 1))
        for lo in range(0, len(dosages), step):
            x, o = decoded(dosages[lo : lo + step])
            f, names, w = (np.array(v[lo : lo + step], t) for v, t in ((families, object), (samples, object), (weights, float)))
            own = f[:, None] == folds[None]
            i, k = np.nonzero(~own if part == "train" else own)
            row_sum = (x @ (keep * s).T - o @ (keep * mean * s).T) / denominator
            diagonal = ((x * x) @ keep.T - 2 * (x @ (keep * mean).T) + o @ (keep * mean * mean).T) / denominator
            if part != "test":
                row_sum, diagonal = row_sum + jitter * w[:, None], diagonal + jitter
            cells = pa.nulls(len(i), pa.float64()) if part == "test" else pa.array(diagonal[i, k])
            yield pa.RecordBatch.from_arrays([pa.array(folds[k], pa.string()), pa.array(names[i], pa.string()), pa.array(n[k]), pa.array(row_sum[i, k]), cells], names=["fold", "sample_i", "n", "row_sum", "diagonal"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, folds, ready = None, [], None
        for batch in batches:
            place, fold, sample, n, v, a, b, c = (x.to_pylist() for x in batch.columns)
            i = 0
            while i < len(place):
                if place[i] != now:
                    now, folds, ready = place[i], [], None
                if n[i] is not None:
                    folds.append((fold[i], n[i], v[i] or np.nan, np.frombuffer(a[i]), np.frombuffer(b[i], bool).astype(float), np.frombuffer(c[i])))
                    i += 1
                    continue
                j = i
                while j < len(place) and place[j] == now:
                    j += 1
                if folds:
                    ready = ready or tuple(np.array(x, object if y == 0 else None) for y, x in enumerate(zip(*folds)))
                    yield from answered(ready, fold[i:j], sample[i:j], v[i:j], a[i:j])
                i = j

    return both.mapInArrow(run, "fold string, sample_i string, n long, row_sum double, diagonal double")
