"""Logistic regression by gradient steps, with labels +1 and -1; gradients are added, as they climb the likelihood."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.operators.skew import sized_join
from hashloom.session import checkpointed


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def gradient(triplets: DataFrame, labels: DataFrame, weights: DataFrame, rate: float) -> DataFrame:
    """(col_id, g): the sum over rows of sigma(-y z) y rate for each active column; one full-batch step.

    ``labels`` is (row_id, y), ``weights`` (col_id, w) with missing ones 0. Rows without label are left out.
    """
    z = sized_join(triplets, weights.select("col_id", "w"), "col_id", "left").groupBy("row_id").agg(F.sum(F.col("value") * F.coalesce("w", F.lit(0.0))).alias("z"))
    push = z.join(labels, "row_id").select("row_id", (sigmoid(-F.col("y") * F.col("z")) * F.col("y") * F.lit(rate)).alias("p"))
    return triplets.join(push, "row_id").groupBy("col_id").agg(F.sum(F.col("value") * F.col("p")).alias("g"))


def ridge(w: Column, penalty: float, rate: float) -> Column:
    return w - w * F.lit(penalty * rate)


def lasso(w: Column, penalty: float, rate: float) -> Column:
    """Towards 0 by a fixed step; a weight that would change its sign becomes 0."""
    step = F.lit(penalty * rate)
    return F.when(F.abs(w) <= step, F.lit(0.0)).otherwise(w - F.signum(w) * step)


def none(w: Column, penalty: float, rate: float) -> Column:
    return w


def step(triplets: DataFrame, labels: DataFrame, weights: DataFrame, rate: float, penalty: float = 0.0, regularise: Callable[[Column, float, float], Column] = none) -> DataFrame:
    """(col_id, w) after one full-batch step and one call of the regulariser."""
    g = gradient(triplets, labels, weights, rate)
    moved = weights.join(g, "col_id", "full").select("col_id", (F.coalesce("w", F.lit(0.0)) + F.coalesce("g", F.lit(0.0))).alias("w"))
    return moved.select("col_id", regularise(F.col("w"), penalty, rate).alias("w"))


class Update(Protocol):
    """What happens to the weights at one point, and at the end of an epoch. ``at`` are the positions of the point's columns, each once."""

    def point(self, w: np.ndarray, at: np.ndarray, values: np.ndarray, y: float, rate: float) -> None: ...

    def end(self, w: np.ndarray, rate: float) -> None: ...


class SgdUpdate:
    """Plain points; ``kind`` none, ridge or lasso once per epoch, or point_ridge: the penalty on the active weights at each point."""

    def __init__(self, kind: str = "none", penalty: float = 0.0):
        if kind not in ("none", "ridge", "lasso", "point_ridge"):
            raise ValueError(kind)
        self.kind, self.penalty = kind, penalty

    def point(self, w: np.ndarray, at: np.ndarray, values: np.ndarray, y: float, rate: float) -> None:
        own = w[at]
        p = y * rate / (1 + np.exp(min(y * float(own @ values), 700.0)))
        w[at] = own + p * values - (self.penalty * rate * own if self.kind == "point_ridge" else 0.0)

    def end(self, w: np.ndarray, rate: float) -> None:
        if self.kind == "ridge":
            w -= self.penalty * rate * w
        elif self.kind == "lasso":
            s = self.penalty * rate
            w[:] = np.where(np.abs(w) <= s, 0.0, w - np.sign(w) * s)


def run_epochs(rows: list[tuple[np.ndarray, np.ndarray, float]], update: Update, rates: list[float], start: dict[int, float] | None = None) -> dict[int, float]:
    """Sequential epochs in the order of ``rows``: the reference order of updates, for data that fits into one task."""
    ids = np.unique(np.concatenate([*[r[0] for r in rows], list(start or {})]).astype(np.int64)) if rows or start else np.empty(0, np.int64)
    w = np.array([(start or {}).get(i, 0.0) for i in ids.tolist()])
    for rate in rates:
        for cols, values, y in rows:
            update.point(w, np.searchsorted(ids, cols), np.asarray(values, float), y, rate)
        update.end(w, rate)
    return dict(zip(ids.tolist(), w.tolist()))


#: Weights that the driver and every worker hold, and rows to a shard.
WEIGHTS, SHARD_ROWS = 20_000_000, 100_000


def sgd_averaged(vectors: DataFrame, labels: DataFrame, update: Update, rates: list[float], seed: int = 0, shards: int | None = None) -> DataFrame:
    """(col_id, w): in every epoch each shard of the rows is run by itself from the common weights, and then the shards are averaged.

    ``vectors`` is packed (row_id, col_ids, vals). A shard is a task, which reads its rows once per epoch in the order of row_id and
    holds nothing but the weights; there is a shard to every SHARD_ROWS rows, or as many as told. Shards are set by the hash of the
    row id, so the result doesn't depend on the layout. With one shard this is the sequential algorithm. More than WEIGHTS columns are
    refused; what shards changed is summed up by column before it reaches the driver.
    """
    data = checkpointed(vectors.select("row_id", "col_ids", "vals").join(labels.select("row_id", "y"), "row_id"))
    columns = checkpointed(data.select(F.explode(F.col("col_ids").cast("array<bigint>")).alias("col_id")).distinct())
    if columns.count() > WEIGHTS:
        raise ValueError(f"more than {WEIGHTS} columns")
    ids = np.sort(columns.toArrow()["col_id"].to_numpy())
    n = shards or max(1, -(-data.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(n)).cast("int")
    placed = data.withColumn("shard", shard)
    placed = placed.repartitionById(n, F.col("shard")) if hasattr(placed, "repartitionById") else placed.repartitionByRange(n, "shard")
    ordered = checkpointed(placed.sortWithinPartitions("shard", "row_id").select("shard", "col_ids", "vals", "y"))
    w = np.zeros(len(ids))
    for rate in rates:
        shared = data.sparkSession.sparkContext.broadcast((ids, w))  # at most WEIGHTS numbers of each

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            own_ids, begin = shared.value
            at, own = None, None
            for b in batches:
                cols, vals = b.column("col_ids"), b.column("vals")
                places, values = np.searchsorted(own_ids, cols.flatten().to_numpy()), vals.flatten().to_numpy()
                ends = np.concatenate(([0], np.cumsum(np.diff(cols.offsets.to_numpy()))))
                for i, (s, y) in enumerate(zip(b.column("shard").to_pylist(), b.column("y").to_pylist())):
                    if s != at:
                        if at is not None:
                            yield changed(own, begin, rate)
                        at, own = s, begin.copy()
                    update.point(own, places[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]].astype(float), float(y), rate)
            if at is not None:
                yield changed(own, begin, rate)

        def changed(own: np.ndarray, begin: np.ndarray, rate: float) -> pa.RecordBatch:
            update.end(own, rate)
            i = np.flatnonzero(own != begin)
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(own[i] - begin[i])], names=["i", "d"])

        moved = ordered.mapInArrow(run, "i bigint, d double").groupBy("i").agg(F.sum("d").alias("d")).toArrow()
        used = ordered.select("shard").distinct().count()
        w = w.copy()
        w[moved["i"].to_numpy()] += moved["d"].to_numpy() / max(1, used)
    return data.sparkSession.createDataFrame(pd.DataFrame({"col_id": ids, "w": w}), "col_id bigint, w double")
