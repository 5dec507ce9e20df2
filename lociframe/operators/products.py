"""Products of training matrices with blocks of vectors, read from packed rows in passes: nothing of markers x markers.

A training set is all families but some. Its matrix Z has a column for each marker: dosages less the training mean (a
missing one gives 0), times a weight (0 where the marker is not retained; one over the deviation where it is to be
standardised). `TrainingSets` holds means and weights of several training sets; `gram_product` gives Z'Z V for all of them
from one pass over the rows, so folds share every pass. Tasks add up in place and send markers in tiles, which are summed in
two steps.

Memory is a matter of (training sets x markers x vectors), in tasks and on the driver; `grouped` splits the training sets so
that this stays below a bound, whatever the number of families. Samples only ever stream by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .gram import decoded

#: Markers that move as one row; parts in which partial sums are added first; bytes of dosages decoded at a time.
TILE, PARTS, DECODED = 1024, 16, 1 << 22
#: Bytes of vectors of a group of training sets.
LIMIT = 256 << 20

_SUMS = "part int, name string, tile int, payload binary"


def _rows(part: list[int], name: list[str], tile: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(name, pa.string()), pa.array(tile, pa.int32()), pa.array(payload, pa.binary())], names=["part", "name", "tile", "payload"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by name and tile of the rows of a task, taken in one by one; rows come sorted, so one sum is held."""
    now, total = None, None
    for batch in batches:
        for part, name, tile, payload in zip(*(x.to_pylist() for x in batch.columns)):
            if (part, name, tile) != now:
                if now is not None:
                    yield _rows([now[0]], [now[1]], [now[2]], [total.tobytes()])
                now, total = (part, name, tile), np.zeros(len(payload) // 8)
            total += np.frombuffer(payload)
    if now is not None:
        yield _rows([now[0]], [now[1]], [now[2]], [total.tobytes()])


def _summed(rows: DataFrame) -> DataFrame:
    """name, tile, payload (sum of doubles) of rows of that form from many tasks, in two steps."""
    key = ["part", "name", "tile"]
    rows = rows.select((F.spark_partition_id() % PARTS).alias("part"), "name", "tile", "payload")
    for last in (False, True):
        rows = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_added, _SUMS)
        if not last:
            rows = rows.withColumn("part", F.lit(0))
    return rows.select("name", "tile", "payload")


def _decoded_parts(dosages: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some rows at a time: which, X (missing as 0) and O."""
    step = max(1, DECODED // max(len(dosages[0]), 1)) if dosages else 1
    for lo in range(0, len(dosages), step):
        part = slice(lo, min(lo + step, len(dosages)))
        yield part, *decoded(dosages[part])


def _small(geno: DataFrame, *columns: str) -> DataFrame:
    return geno.select(F.col("family_id").cast("string").alias("family_id"), "dosages", *columns)


def family_sums(geno: DataFrame) -> DataFrame:
    """name (family), tile, payload: O'1, X'1, (X * X)'1, X'y, O'y of a tile of markers (five runs of doubles), and in tile
    -1 n, sum y and sum y^2. geno: family_id, dosages, yield. A task sends when its families take LIMIT / 4 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for family, s in sums.items():
                m = (len(s) - 3) // 5
                v = s[:-3].reshape(5, m)
                yield _rows([0], [family], [-1], [s[-3:].tobytes()])
                for t in range(0, m, TILE):
                    yield _rows([0], [family], [t // TILE], [np.ascontiguousarray(v[:, t : t + TILE]).tobytes()])
            sums.clear()

        for batch in batches:
            families = np.array(batch.column(0).to_pylist())
            y_all = batch.column(2).to_numpy(zero_copy_only=False)
            for part, x, o in _decoded_parts(batch.column(1).to_pylist()):
                for family in np.unique(families[part]):
                    own = families[part] == family
                    a, b, y = x[own], o[own], y_all[part][own]
                    s = np.concatenate((b.sum(0), a.sum(0), (a * a).sum(0), a.T @ y, b.T @ y, [len(y), y.sum(), y @ y]))
                    sums[family] = sums.get(family, 0) + s
                if sum(s.nbytes for s in sums.values()) > LIMIT // 4:
                    yield from sent()
        yield from sent()

    rows = _small(geno, F.col("yield").cast("double").alias("y")).mapInArrow(run, _SUMS)
    return _summed(rows)


@dataclass
class TrainingSets:
    """names and excluded families of training sets; n, sy, syy (each a number a set) and markers' sums (sets x markers):
    so, sx, sxx, xy, oy; weight and mean as the filter set them."""

    names: list[tuple[str, str]]
    excluded: list[frozenset]
    n: np.ndarray
    sy: np.ndarray
    syy: np.ndarray
    sums: dict[str, np.ndarray]
    mean: np.ndarray = None
    weight: np.ndarray = None

    @property
    def markers(self) -> int:
        return self.sums["so"].shape[1]

    def statistics(self, i: int) -> dict[str, np.ndarray]:
        """As gram.Moments.statistics, of one training set."""
        s = {k: v[i] for k, v in self.sums.items()}
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(s["so"] > 0, s["sx"] / s["so"], np.nan)
            variance = (s["sxx"] - s["so"] * np.nan_to_num(mean) ** 2) / self.n[i]
        p = (mean + 1) / 2
        return {"observed_rate": s["so"] / self.n[i], "mean": mean, "variance": variance, "allele_freq": p, "maf": np.minimum(p, 1 - p)}

    def filtered(self, keep: Callable[[dict], tuple[np.ndarray, np.ndarray]], standardise: bool = False) -> TrainingSets:
        """With mean and weight of each set; keep: statistics to (retained, means). Raises where none is retained."""
        self.mean, self.weight = np.zeros_like(self.sums["so"]), np.zeros_like(self.sums["so"])
        for i, name in enumerate(self.names):
            s = self.statistics(i)
            kept, mean = keep(s)
            if not kept.any():
                raise ValueError(f"no marker is left for the fold of {name[0]}")
            self.mean[i, kept] = mean[kept]
            self.weight[i, kept] = 1 / np.sqrt(s["variance"][kept]) if standardise else 1.0
        return self

    @property
    def zy(self) -> np.ndarray:
        """Z'y of each set."""
        return self.weight * (self.sums["xy"] - self.mean * self.sums["oy"])


def training_sets(sums: DataFrame, plan: list[tuple[str, str, frozenset]]) -> TrainingSets:
    """The sums of each training set (name, stage, excluded families): those of all families less the excluded ones.

    sums: family_sums. What comes to the driver are sets x markers numbers, five times.
    """
    names = [f"{a}\t{b}" for a, b, _ in plan]
    signs = [(n, f) for n, (_, _, out) in zip(names, plan) for f in out]
    total = sums.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("set"), F.lit(1.0).alias("sign"), "tile", "payload")
    less = sums.join(F.broadcast(sums.sparkSession.createDataFrame(signs, "set string, name string")), "name").select("set", F.lit(-1.0).alias("sign"), "tile", "payload") if signs else None
    every = total if less is None else total.unionByName(less)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sign, tile, payload in zip(*(x.to_pylist() for x in batch.columns)):
                yield _rows([0], [name], [tile], [(sign * np.frombuffer(payload)).tobytes()])

    got: dict[str, dict[int, np.ndarray]] = {n: {} for n in names}
    for r in _summed(every.mapInArrow(run, _SUMS)).toLocalIterator():
        got[r["name"]][r["tile"]] = np.frombuffer(r["payload"])
    if not all(got.values()):
        raise ValueError("no rows")
    heads = np.stack([got[n][-1] for n in names])
    stacked = np.stack([np.concatenate([got[n][t].reshape(5, -1) for t in range(max(got[n]) + 1)], 1) for n in names])
    return TrainingSets([(a, b) for a, b, _ in plan], [out for _, _, out in plan], heads[:, 0], heads[:, 1], heads[:, 2], dict(zip(("so", "sx", "sxx", "xy", "oy"), stacked.transpose(1, 0, 2))))


def grouped(plan: list, markers: int, vectors: int, limit: int = LIMIT) -> list[list]:
    """The plan in groups of training sets whose vectors (of so many each) take at most `limit` bytes, or of one set."""
    each = max(1, limit // max(8 * markers * vectors, 1))
    return [plan[i : i + each] for i in range(0, len(plan), each)]


def marker_count(geno: DataFrame) -> int:
    row = geno.select(F.octet_length("dosages").alias("m")).first()
    if row is None:
        raise ValueError("no rows")
    return int(row["m"])


def gram_product(geno: DataFrame, sets: TrainingSets) -> Callable[[np.ndarray], np.ndarray]:
    """A function from vectors V (sets x markers x columns) to Z'Z V, one pass over the rows a call."""
    spark = geno.sparkSession
    fixed = spark.sparkContext.broadcast((sets.mean, sets.weight, sets.excluded))
    rows = _small(geno)

    def product(v: np.ndarray) -> np.ndarray:
        f, m, c = v.shape
        sent = spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, weight, excluded = fixed.value
            forward = (weight[:, :, None] * sent.value).transpose(1, 0, 2)  # markers x sets x columns
            shifted = np.ascontiguousarray((mean.T[:, :, None] * forward).reshape(m, f * c))
            forward = np.ascontiguousarray(forward.reshape(m, f * c))
            back_x, back_o = np.zeros((m, f * c)), np.zeros((m, f * c))
            for batch in batches:
                families = batch.column(0).to_pylist()
                for part, x, o in _decoded_parts(batch.column(1).to_pylist()):
                    u = (x @ forward - o @ shifted).reshape(len(x), f, c)
                    for i, out in enumerate(excluded):
                        u[[g in out for g in families[part]], i] = 0
                    u = u.reshape(len(x), f * c)
                    back_x += x.T @ u
                    back_o += o.T @ u
            done = (weight.T[:, :, None] * (back_x.reshape(m, f, c) - mean.T[:, :, None] * back_o.reshape(m, f, c))).reshape(m, f * c)
            for t in range(0, m, TILE):
                yield _rows([0], [""], [t // TILE], [np.ascontiguousarray(done[t : t + TILE]).tobytes()])

        out = np.zeros((m, f * c))
        for r in _summed(rows.mapInArrow(run, _SUMS)).collect():
            s = np.frombuffer(r["payload"]).reshape(-1, f * c)
            out[r["tile"] * TILE : r["tile"] * TILE + len(s)] = s
        sent.destroy()
        return np.ascontiguousarray(out.reshape(m, f, c).transpose(1, 0, 2))

    return product


def squared_errors(geno: DataFrame, sets: TrainingSets, weights: np.ndarray, families: list[str], centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Mean squared error of Z w (weights: sets x markers x columns) for the traits, less centre and over scale, of one family
    for each set (not among its training rows): sets x columns, from one pass. geno: family_id, dosages, yield."""
    spark = geno.sparkSession
    fixed = spark.sparkContext.broadcast((sets.mean, sets.weight, weights))
    f, m, c = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, weight, w = fixed.value
        total = np.zeros((f, c + 1))
        for batch in batches:
            own, y_all = np.array(batch.column(0).to_pylist()), batch.column(2).to_numpy(zero_copy_only=False)
            for part, x, o in _decoded_parts(batch.column(1).to_pylist()):
                for i, family in enumerate(families):
                    at = own[part] == family
                    if at.any():
                        z = (x[at] - o[at] * mean[i]) * weight[i]
                        gap = (y_all[part][at][:, None] - centre[i]) / scale[i] - z @ w[i]
                        total[i] += np.append((gap * gap).sum(0), at.sum())
        yield _rows([0], [""], [0], [total.tobytes()])

    got = _summed(_small(geno, F.col("yield").cast("double").alias("y")).mapInArrow(run, _SUMS)).collect()
    total = np.frombuffer(got[0]["payload"]).reshape(f, c + 1)
    if not (total[:, -1] > 0).all():
        raise ValueError("a validation family has no rows")
    return total[:, :-1] / total[:, -1:]
