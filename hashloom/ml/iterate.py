"""Iterative algorithms on mergeable accumulators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Cells of a dense accumulator (80 MB).
CELLS = 10_000_000


class Accumulated(Protocol):
    """``start`` gives the accumulator, ``add`` takes one batch into a fresh one, ``end`` says whether to stop."""

    def start(self) -> np.ndarray: ...

    def add(self, batch: pd.DataFrame, into: np.ndarray, state: np.ndarray) -> None: ...

    def end(self, iteration: int, sums: np.ndarray) -> bool: ...


def partial_sums(data: DataFrame, shape: tuple[int, ...], add: Callable[[pd.DataFrame, np.ndarray], None]) -> np.ndarray:
    """Element-wise sums of dense accumulators: one partial per task, added up by position before they reach the driver.

    Every task and the driver hold one accumulator, so more than CELLS cells are refused: use ``array_sums`` for those.
    """
    if int(np.prod(shape)) > CELLS:
        raise ValueError(f"accumulators of more than {CELLS} cells don't belong in one task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(shape)
        for pdf in batches:
            add(pdf, own)
        flat = own.ravel()
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"i": at, "v": flat[at]})

    out = np.zeros(int(np.prod(shape)))
    for r in data.mapInPandas(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"]] = r["v"]
    return out.reshape(shape)


def run(data: DataFrame, algorithm: Accumulated, iterations: int) -> tuple[np.ndarray, int]:
    """(last sums, rounds): at most ``iterations`` passes. Each starts from zero; the sums of the last pass are handed to the next."""
    state, done = algorithm.start(), 0
    for done in range(1, iterations + 1):
        now = state
        state = partial_sums(data, now.shape, lambda pdf, own, now=now: algorithm.add(pdf, own, now))
        if algorithm.end(done, state):
            break
    return state, done


def array_sums(rows: DataFrame, key: str, array: str) -> DataFrame:
    """(key, i, total): element-wise sums of arrays by key, in long form."""
    return rows.select(key, F.posexplode(array).alias("i", "v")).groupBy(key, "i").agg(F.sum(F.col("v").cast("double")).alias("total"))
