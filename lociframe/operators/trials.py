"""Early stopping on metric logs, and selection and halving of sweep trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociframe.functions.scalars import choice, log_uniform, uniform

#: How much better a loss must be; rungs and share of the halving.
MIN_DELTA = 1e-12
RUNGS, ETA = (4, 8, 16), 2


def best_epoch(log: DataFrame, patience: int = 10, keys: tuple[str, ...] = ("run", "fold")) -> DataFrame:
    """keys, best_epoch, best_loss: the last improving epoch before `patience` epochs in a row without improvement.

    A loss improves if it is below the best so far by more than MIN_DELTA; without any (all NaN) the epoch is 1. The
    exact recurrence runs over each log's epochs in order, inside the row of the log.
    """
    rows = log.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("epoch", "loss"))).alias("v"))
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(1).cast("bigint").alias("at"), F.lit(0).alias("waited"))

    def step(acc: Column, x: Column) -> Column:
        better = (acc["waited"] < patience) & (x["loss"] < acc["best"] - MIN_DELTA) & ~F.isnan(x["loss"])
        return F.struct(
            F.when(better, x["loss"]).otherwise(acc["best"]).alias("best"),
            F.when(better, x["epoch"].cast("bigint")).otherwise(acc["at"]).alias("at"),
            F.when(acc["waited"] >= patience, acc["waited"]).when(better, 0).otherwise(acc["waited"] + 1).alias("waited"),
        )

    out = rows.select(*keys, F.aggregate("v", zero, step).alias("a"))
    return out.select(*keys, F.col("a.at").alias("best_epoch"), F.when(F.col("a.best") != float("inf"), F.col("a.best")).alias("best_loss"))


def best_epoch_max(log: DataFrame, patience: int = 10, metric: str = "loss", keys: tuple[str, ...] = ("run", "fold")) -> DataFrame:
    """The same for a metric to be maximised: strictly greater improves, NaN counts as -1."""
    value = -F.when(F.isnan(metric), F.lit(-1.0)).otherwise(F.col(metric))
    rows = log.select(*keys, "epoch", value.alias("loss")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("epoch", "loss"))).alias("v"))
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(1).cast("bigint").alias("at"), F.lit(0).alias("waited"))

    def step(acc: Column, x: Column) -> Column:
        better = (acc["waited"] < patience) & (x["loss"] < acc["best"])
        return F.struct(
            F.when(better, x["loss"]).otherwise(acc["best"]).alias("best"), F.when(better, x["epoch"].cast("bigint")).otherwise(acc["at"]).alias("at"),
            F.when(acc["waited"] >= patience, acc["waited"]).when(better, 0).otherwise(acc["waited"] + 1).alias("waited"),
        )

    return rows.select(*keys, F.aggregate("v", zero, step).alias("a")).select(*keys, F.col("a.at").alias("best_epoch"), (-F.col("a.best")).alias("best_score"))


def best_trial(scores: DataFrame, trial: str = "run", score: str = "score") -> DataFrame:
    """The trial with the highest mean score (ties: the least id)."""
    return scores.groupBy(trial).agg(F.avg(score).alias("mean_score")).orderBy(F.desc("mean_score"), trial).limit(1)


def halved(scores: DataFrame, trial: str = "run", fold_index: str = "fold_index", score: str = "score", rungs: tuple[int, ...] = RUNGS, eta: int = ETA) -> DataFrame:
    """trial, rung, mean_score, kept: at each rung r the trials left are ranked by the mean of their first r folds and
    the better half (rounded up) goes on."""
    left, out = scores.select(trial).distinct(), None
    for r in rungs:
        means = scores.filter(F.col(fold_index) < r).join(left, trial, "left_semi").groupBy(trial).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == r)
        n = means.agg(F.ceil(F.count(F.lit(1)) / eta).alias("keep"))
        # Trials are few: their ranking is one window.
        ranked = means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_score"), trial))).join(F.broadcast(n), F.lit(True))
        rung = ranked.select(trial, F.lit(r).alias("rung"), "mean_score", (F.col("place") <= F.col("keep")).alias("kept"))
        left = rung.filter("kept").select(trial)
        out = rung if out is None else out.unionByName(rung)
    return out


def draw_trials(spark, n: int, space: dict[str, tuple], seed: int = 42) -> DataFrame:
    """n trials of a search space: name -> ('choice', values), ('uniform', lo, hi) or ('log_uniform', lo, hi)."""
    out = spark.range(n).withColumnRenamed("id", "trial")
    for i, (name, (kind, *args)) in enumerate(space.items()):
        u = F.rand(seed + i)
        out = out.withColumn(name, choice(u, args[0]) if kind == "choice" else uniform(u, *args) if kind == "uniform" else log_uniform(u, *args))
    return out
