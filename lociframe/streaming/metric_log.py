"""A stream of metric rows watched for the best epoch of each run and fold, with one small state row each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lociframe.operators.trials import MIN_DELTA

STATE = "best double, at long, waited int, last long"
OUT = "run string, fold string, best_epoch long, best_loss double, stopped boolean"


def watch(stream: DataFrame, patience: int = 10) -> DataFrame:
    """run, fold, best_epoch, best_loss, stopped after each batch; rows (run, fold, epoch, loss) of epochs already
    passed are late and ignored, as early stopping goes forward only."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, at, waited, last = state.get if state.exists else (float("inf"), 1, 0, 0)
        rows = pd.concat(list(parts)).sort_values("epoch")
        for epoch, loss in zip(rows["epoch"], rows["loss"]):
            if epoch <= last or waited >= patience:
                continue
            last = int(epoch)
            if loss < best - MIN_DELTA:
                best, at, waited = float(loss), int(epoch), 0
            else:
                waited += 1
        state.update((best, at, waited, last))
        yield pd.DataFrame({"run": [key[0]], "fold": [key[1]], "best_epoch": [at], "best_loss": [best], "stopped": [waited >= patience]})

    rows = stream.selectExpr("cast(run as string) run", "cast(fold as string) fold", "cast(epoch as long) epoch", "cast(loss as double) loss")
    return rows.groupBy("run", "fold").applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")
